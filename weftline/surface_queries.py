"""Registered queries for the rest of the surface: user functions, vectors, growing recursion, logs, streams, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import egraph, testkit
from weftline.egraph import validate
from weftline.functions import lattice, semiring, user
from weftline.operators import columnar, graph, temporal, zset
from weftline.plans import analysis, rewrite
from weftline.plans.engine import Engine
from weftline.plans.parser import parse
from weftline.queries import _MS, _SESSIONS, _TRADE, _events, _program, _query, _t, trade
from weftline.session import scratch, scratch_path
from weftline.sources import storage
from weftline.streaming import windows
from weftline.streaming.incremental import Maintained
from weftline.streaming.sessions import session_changes

# User functions.


@_query("SELECT l_orderkey AS id, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) || '!' AS flag FROM lineitem")
def user_map(spark: SparkSession, sf: str) -> DataFrame:
    """A projection by expressions, then a Python function of each row."""
    li = user.mapped(_t(spark, sf, "lineitem"), id="l_orderkey", net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), flag="l_returnflag")
    return user.map_rows(li, lambda r: (r[0], r[1], r[2].upper() + "!"), "id long, net double, flag string")


@_query("SELECT p_partkey AS id, unnest(string_split(p_type, ' ')) AS word FROM part")
def user_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Any number of rows for each."""
    p = _t(spark, sf, "part").select("p_partkey", "p_type")
    return user.expand(p, lambda r: ((r[0], w) for w in r[1].split(" ")), "id long, word string")


@_query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 AND c_custkey % 3 = 1")
def user_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")).where("balance > 5000")
    return user.filter_rows(c, lambda r: r[0] % 3 == 1)


@_query("SELECT c_name || ':' || o_orderpriority AS label, round(o_totalprice - c_acctbal, 2) AS gap FROM customer JOIN orders ON c_custkey = o_custkey")
def user_combine(spark: SparkSession, sf: str) -> DataFrame:
    """A join whose rows are made from both sides by an expression of the user."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal")
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_totalprice")
    return user.combined(c, o, ["k"], lambda left, right: {"label": F.concat_ws(":", left("c_name"), right("o_orderpriority")), "gap": F.round(right("o_totalprice") - left("c_acctbal"), 2)})


@_query("SELECT o_custkey AS id, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY 1")
def user_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate of one's own: the spread of a group, folded before the shuffle."""
    o = zset.lift(_t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_totalprice"))
    spread = user.Aggregator(lambda: (float("inf"), float("-inf")), lambda s, v, w: (min(s[0], v[0]), max(s[1], v[0])) if w > 0 else s, lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: round(s[1] - s[0], 4), "double")
    return user.aggregate_with(o, ["id"], ["o_totalprice"], "spread", spread)


# Weighted relations.


@_query("SELECT l_returnflag AS flag, CAST(sum(l_linenumber * CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END) AS BIGINT) AS total, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def zset_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and counts by weight: rows of status F count twice."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("flag"), "l_linestatus")
    d = zset.lift(li).withColumn("__w", F.when(F.col("l_linestatus") == "F", F.lit(2).cast("long")).otherwise(F.lit(1).cast("long")))
    return zset.aggregate(d, ["flag"], total=("sum", "line"), n=("count", None))


@_query("SELECT id, CAST(sum(w) AS BIGINT) AS w FROM (SELECT o_custkey AS id, 1 AS w FROM orders UNION ALL SELECT c_custkey, -2 FROM customer) GROUP BY id HAVING sum(w) <> 0")
def zset_union(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of two relations added; rows that come to zero go."""
    o, c = zset.lift(_t(spark, sf, "orders").select(F.col("o_custkey").alias("id"))), zset.lift(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), weight=-2)
    return zset.merge(o, c).select("id", F.col("__w").alias("w"))


@_query("SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def rule_intersection(spark: SparkSession, sf: str) -> DataFrame:
    text = "both(N) :- supplier(N, A), A > 0, customer(N, B), B > 9000."
    return _program(spark, sf, text, {"supplier": ["s_nationkey", "s_acctbal"], "customer": ["c_nationkey", "c_acctbal"]}, "both", ["n"])


@_query("SELECT s_nationkey AS nation, CAST(min(greatest(s_suppkey % 3, p_partkey % 4)) AS INT) AS level FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING min(greatest(s_suppkey % 3, p_partkey % 4)) < 3")
def semiring_access(spark: SparkSession, sf: str) -> DataFrame:
    """Clearance levels: a join takes the stricter, a union the laxer, and what stays secret is absent."""
    ring = semiring.ACCESS
    li = _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 3).cast("int").alias("a"))
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 4).cast("int").alias("b"))
    d = li.join(s, "l_suppkey").join(p, "l_partkey").select("nation", ring.times_col(F.col("a"), F.col("b")).alias("__w"))
    return zset.consolidate(d, ring).select("nation", F.col("__w").alias("level"))


@_query("SELECT l_orderkey AS id, l_linenumber AS line, [greatest(l_linenumber, 3), greatest(l_orderkey % 5, 2)]::BIGINT[] AS up, l_linenumber <= 3 AND l_orderkey % 5 <= 2 AS before, (l_linenumber < 3 AND l_orderkey % 5 > 2) OR (l_linenumber > 3 AND l_orderkey % 5 < 2) AS beside FROM lineitem")
def lattice_times(spark: SparkSession, sf: str) -> DataFrame:
    """Join and order of logical times that are vectors."""
    at, other = F.array(F.col("l_linenumber").cast("long"), F.col("l_orderkey") % 5), F.array(F.lit(3).cast("long"), F.lit(2).cast("long"))
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), lattice.join(at, other).alias("up"), lattice.before_or_at(at, other).alias("before"), lattice.concurrent(at, other).alias("beside"))


# Recursion over relations that grow with the data.

_NEXT = "e AS (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)"


def _next_orders(spark: SparkSession, sf: str) -> DataFrame:
    """a, b: each order and its customer's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b IS NOT NULL")


@_query(f"WITH RECURSIVE {_NEXT}, tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a, b FROM tc")
def order_chain_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A closure by squaring over an edge for almost every order."""
    return _program(spark, sf, "later(X, Y) :- next(X, Y). later(X, Z) :- next(X, Y), later(Y, Z).", {"next": _next_orders(spark, sf)}, "later", ["a", "b"])


@_query(f"WITH RECURSIVE {_NEXT}, r(n) AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.b FROM r JOIN e ON r.n = e.a) SELECT n FROM r")
def order_chain_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Semi-naive rounds: all orders at or after an urgent one of the same customer."""
    tables = {"next": _next_orders(spark, sf), "orders": ["o_orderkey", "o_orderpriority"]}
    return _program(spark, sf, 'after(X) :- orders(X, "1-URGENT"). after(Y) :- after(X), next(X, Y).', tables, "after", ["n"])


@_query(f"WITH RECURSIVE {_NEXT}, pt(v, o) AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT e.b, pt.o FROM pt JOIN e ON pt.v = e.a) SELECT v, o FROM pt")
def points_to(spark: SparkSession, sf: str) -> DataFrame:
    """What variables may hold: allocations, and assignments from one variable to the next."""
    alloc = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    assign = _next_orders(spark, sf).select("b", "a")
    return _program(spark, sf, "pt(V, O) :- alloc(V, O). pt(V, O) :- assign(V, W), pt(W, O).", {"alloc": alloc, "assign": assign}, "pt", ["v", "o"])


@_query(f"WITH RECURSIVE {_NEXT}, tc(a, b) AS (SELECT a, b FROM e WHERE a % 20 <> 0 UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a AND e.a % 20 <> 0) SELECT a, b FROM tc")
def incremental_retraction(spark: SparkSession, sf: str) -> DataFrame:
    """A closure kept up while edges go and come: what rested on them goes, what has another derivation stays."""
    e = scratch(_next_orders(spark, sf), "next")
    m = Maintained(spark, "later(X, Y) :- next(X, Y). later(X, Z) :- next(X, Y), later(Y, Z).", {"next": e.where("a % 30 <> 1")})
    m.apply("next", e.where("a % 20 = 0 OR a % 30 = 1").withColumn("w", F.when(F.col("a") % 20 == 0, -1).otherwise(1)), "w")
    return m.state["later"].toDF("a", "b")


@_query(f"WITH RECURSIVE {_TRADE}, tc(a, b) AS (SELECT a, b FROM e WHERE a <> 5 UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a AND e.a <> 5), was(a, b) AS (SELECT a, b FROM e WHERE a <> 3 UNION SELECT was.a, e.b FROM was JOIN e ON was.b = e.a AND e.a <> 3) SELECT a, b, 1::BIGINT AS w FROM (SELECT * FROM tc EXCEPT SELECT * FROM was) UNION ALL SELECT a, b, -1 FROM (SELECT * FROM was EXCEPT SELECT * FROM tc)")
def incremental_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The change log of two epochs, summed."""
    e = trade(spark, sf).select("a", "b")
    m = Maintained(spark, "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", {"edge": e.where("a <> 3")})
    m.apply("edge", e.where("a = 3"))
    m.apply("edge", e.where("a = 5").withColumn("w", F.lit(-1)), "w")
    return m.outputs("path").groupBy("c0", "c1").agg(F.sum("__w").alias("w")).where("w <> 0").toDF("a", "b", "w")


@_query(f"WITH RECURSIVE {_TRADE}, tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT 'path' AS predicate, count(*) AS n FROM tc")
def program_profile(spark: SparkSession, sf: str) -> DataFrame:
    """New rows of every round, by predicate."""
    engine = Engine(spark, "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", {"edge": trade(spark, sf).select("a", "b")})
    total: dict[str, int] = {}
    for step in engine.steps():
        for p, n in step.new.items():
            total[p] = total.get(p, 0) + (n or 0)
    return spark.createDataFrame(sorted(total.items()), "predicate string, n long")


@_query("SELECT * FROM (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 1), (5, 2), (5, 3), (5, 4)) AS t(a, b)")
def incremental_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts inserted and retracted one by one into a program that is kept up to date."""
    e = Engine(spark, "edge(1, 2). edge(2, 3). edge(3, 1). path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", incremental=True)
    e.run()
    for change, row in ((e.insert, (3, 4)), (e.retract, (3, 1)), (e.insert, (5, 1)), (e.insert, (5, 1)), (e.retract, (5, 1))):
        change("edge", row)
    return e.query("path").select(F.col("c0").cast("int").alias("a"), F.col("c1").cast("int").alias("b"))


# Graphs.


@_query(f"WITH {_TRADE} SELECT DISTINCT x.a AS src, y.b AS dst FROM e x JOIN e y ON x.b = y.a JOIN nation s ON s.n_nationkey = x.a JOIN nation d ON d.n_nationkey = y.b WHERE s.n_regionkey = 1 AND d.n_regionkey = 3")
def path_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Two trades from a nation of one region to one of another, over a property graph."""
    v = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("labels"), F.create_map(F.lit("name"), "n_name").alias("properties"))
    e = trade(spark, sf).select(F.concat_ws(">", "a", "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("BUYS").alias("label"), F.create_map(F.lit("weight"), F.col("w").cast("string")).alias("properties"))
    return graph.path_pattern(graph.PropertyGraph(v, e), [("x", "R1"), ("y", None), ("z", "R3")], ["BUYS", "BUYS"])


@_query(f"WITH {_TRADE} SELECT a AS src, b AS dst, round(w, 4) AS w FROM e WHERE a IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def property_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A property graph as a weighted relation, out of the vertices with a label."""
    v = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("labels"), F.create_map(F.lit("name"), "n_name").alias("properties"))
    e = trade(spark, sf).select(F.concat_ws(">", "a", "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("BUYS").alias("label"), F.create_map(F.lit("weight"), F.col("w").cast("string")).alias("properties"))
    g = graph.PropertyGraph(v, e)
    return g.weighted().join(g.with_label("R2").select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", F.round("w", 4).alias("w"))


@_query(f"WITH RECURSIVE {_TRADE}, h(x, k, u) AS (SELECT 3, 0, 0 UNION ALL SELECT e.b, h.k + 1, h.u + CASE WHEN e.a = 3 AND e.b = (SELECT min(b) FROM e WHERE a = 3) THEN 1 ELSE 0 END FROM h JOIN e ON h.x = e.a WHERE h.k < 3) SELECT x AS account, CAST(sum(u) AS DOUBLE) AS d FROM h GROUP BY x")
def taint_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """How much each account's derivations hang on one transfer: the partial derivative at ones."""
    t = trade(spark, sf)
    first = t.where("a = 3").agg(F.min("b").alias("b")).first()["b"]
    found = graph.taint(t.select(F.concat_ws(">", "a", "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst")), 3, max_hops=3)
    return graph.sensitivity(found, f"3>{first}", {})


# Time and streams.


@_query(f"SELECT date_trunc('month', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a calendar: months."""
    e = _t(spark, sf, "events").select("event_type", "ts")
    month = lambda t: F.array(F.struct(F.date_trunc("month", t).cast("timestamp_ntz").alias("start"), F.add_months(F.date_trunc("month", t), 1).cast("timestamp_ntz").alias("end")))
    return temporal.assign(e, "ts", month).groupBy("start", "event_type").agg(F.count("*").alias("n"))


@_query(f"SELECT event_id, {_MS} % 3600000 < 1800000 AS early FROM events")
def window_contains(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    half = F.struct((F.col("t") - F.col("t") % 3_600_000).alias("start"), (F.col("t") - F.col("t") % 3_600_000 + 1_800_000).alias("end"))
    return e.select("event_id", temporal.contains(half, F.col("t")).alias("early"))


@_query(f"SELECT event_id, min((event_type = 'view')::INT) OVER w = 1 AS alw, max((event_type = 'view')::INT) OVER w = 1 AS ev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_MS} RANGE BETWEEN CURRENT ROW AND 36000000 FOLLOWING)")
def temporal_logic_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """Always and eventually in slices of time, for keys of any size."""
    h, p = temporal.Holds(["user_id"], "t", within=36_000_000), F.col("event_type") == "view"
    return h.prepared(_events(spark, sf)).select("event_id", h.always(p, 36_000_000).alias("alw"), h.eventually(p, 36_000_000).alias("ev"), "__own").where("__own").drop("__own")


def _streamed(spark: SparkSession, df: DataFrame, files: int = 4) -> DataFrame:
    """A table as a stream of a few micro-batches."""
    path = scratch_path(spark, "stream")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _written(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to its end, and what it wrote."""
    path = scratch_path(spark, "sink")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, k: df.write.mode("append").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@_query(f"SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts - INTERVAL 1 HOUR AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """The interval join of two streams in micro-batches."""
    e = _t(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    clicks, buys = (_streamed(spark, e.where(F.col("event_type") == k), 2) for k in ("click", "purchase"))
    out = windows.interval_join(clicks, buys, "user_id", "ts", "ts", "1 hour", "1 hour")
    return _written(spark, out.select(F.col("event_id").alias("click"), F.col("r_event_id").alias("purchase")))


@_query(_SESSIONS)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions in the state store, out of order and merged as events come; the sum of the changes that were told."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = _written(spark, session_changes(_streamed(spark, _events(spark, sf).select("user_id", "t")), "user_id", "t", 7_200_000), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return told.groupBy("user_id", "start", "end", "events").agg(F.sum("__w").alias("w")).where("w = 1").drop("w")


@_query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day of a stream without a watermark: late rows still count; the last form of every window."""
    e = _t(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    told = _written(spark, windows.tumbling_counts(_streamed(spark, e), "ts", "1 day", ["event_type"]), "update")
    return told.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("events").alias("events"))


@_query("SELECT sum(CASE WHEN o_orderkey % 10 = 3 THEN 7 ELSE o_custkey END)::BIGINT AS total FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def range_total(spark: SparkSession, sf: str) -> DataFrame:
    """The sum over a range of positions after some of them have changed."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))
    now = temporal.updated(o, o.where("i % 10 = 3").select("i", F.lit(7).cast("long").alias("v")), "i")
    return temporal.range_sum(now, "i", "v", 100, 900, semiring.COUNTING)


# Vectors, positions, hashes.


@_query("SELECT index FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index, o_orderstatus AS s FROM orders) WHERE s = 'P'")
def column_filter_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Positions, in order of price, of the orders with a status."""
    return columnar.filter_indices(_t(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], F.col("o_orderstatus") == "P")


@_query("SELECT o_orderkey AS id, row_number() OVER w AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, lag(o_totalprice) OVER w AS lag, lead(o_totalprice) OVER w AS lead, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_functions(spark: SparkSession, sf: str) -> DataFrame:
    out = columnar.window_functions(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "id"], "o_totalprice")
    return out.select("id", *[F.col(c).cast("long").alias(c) for c in ("row_number", "rank", "dense_rank")], "lag", "lead", F.round("running", 2).alias("running"))


@_query("SELECT o_custkey AS id, list_sort(list(o_totalprice)) AS prices, list_sort(list(o_totalprice))[1:2] AS least, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds FROM orders GROUP BY 1")
def column_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in order, their prefix, and the size of a dictionary."""
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(columnar.sorted_vector(F.collect_list("o_totalprice")).alias("prices"), F.count_distinct("o_orderpriority").alias("kinds"))
    return o.select("id", "prices", columnar.prefix(F.col("prices"), 2).alias("least"), "kinds")


@_query("SELECT max(o_totalprice = 100000.0) AS found, CAST(count(*) FILTER (o_totalprice < 100000.0) AS BIGINT) AS place FROM orders")
def column_search(spark: SparkSession, sf: str) -> DataFrame:
    return columnar.place_of(_t(spark, sf, "orders"), "o_totalprice", 100000.0)


@_query("SELECT n_nationkey AS id, [n_name, n_regionkey::VARCHAR] AS pick, [n_name] AS last FROM nation")
def tuple_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of rows by place, and their ends."""
    row = F.array(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), "n_name")
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), columnar.project(row, 2, 0).alias("pick"), columnar.suffix(row, 1).alias("last"))


@_query("WITH RECURSIVE h(n, k, v) AS (SELECT r_name, 0, 0::BIGINT FROM region UNION ALL SELECT n, k + 1, (v * 31 + ascii(substr(n, k + 1, 1))) % 4294967296 FROM h WHERE k < length(n)) SELECT n AS name, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INT) AS hash FROM h WHERE k = length(n)")
def string_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "region").select(F.col("r_name").alias("name"), columnar.hash31(F.col("r_name")).alias("hash"))


@_query("SELECT count(*) AS rows, 0::BIGINT AS torn, true AS even FROM orders")
def hash_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Eight lots by hash of the customer: all rows are in one, no customer in two, and none has twice its share of customers."""
    o, n = _t(spark, sf, "orders").select("o_custkey"), 8
    lots = None
    for i, lot in enumerate(columnar.split_batch(o, ["o_custkey"], n)):
        part = lot.groupBy("o_custkey").agg(F.count("*").alias("c")).withColumn("lot", F.lit(i))
        lots = part if lots is None else lots.unionByName(part)
    lots = scratch(lots, "lots")
    torn = lots.groupBy("o_custkey").agg(F.count("*").alias("k")).agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("torn"))
    sizes = lots.groupBy("lot").agg(F.count("*").alias("keys"), F.sum("c").alias("c")).agg(F.sum("c").alias("rows"), (F.max("keys") * n <= 2 * F.sum("keys")).alias("even"))
    return sizes.crossJoin(torn).select("rows", "torn", "even")  # a row each


@_query("SELECT 1000::BIGINT AS n, true AS same, true AS bounded")
def random_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Two relations of one seed are equal, and their values within bounds."""
    a, b = (testkit.relation(spark, 1000, ["bigint", "string", "boolean"]) for _ in range(2))
    return a.agg(F.count("*").alias("n"), (F.min("c0") >= 0).alias("low"), (F.max("c0") < 100).alias("high")).select("n", F.lit(a.exceptAll(b).isEmpty()).alias("same"), (F.col("low") & F.col("high")).alias("bounded"))


# Logs and snapshots.


@_query("SELECT o_orderkey % 3 + 1 AS epoch, 'orders' AS pred, '[\"' || o_custkey || '\",\"' || o_orderpriority || '\"]' AS row, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END::BIGINT AS weight FROM orders")
def change_log_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of a log in order, each checked against its CRC."""
    log = storage.ChangeLog(spark, scratch_path(spark, "log"))
    row = F.to_json(F.array(F.col("o_custkey").cast("string"), "o_orderpriority"))
    log.append_frame(_t(spark, sf, "orders").select((F.col("o_orderkey") % 3 + 1).alias("epoch"), F.col("o_orderkey").alias("seq"), F.lit("orders").alias("pred"), row.alias("row"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(1).cast("long").alias("weight")))
    return log.replay()


@_query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    storage.save_snapshot(path, {"nation": _t(spark, sf, "nation"), "region": _t(spark, sf, "region")})
    held = storage.load_snapshot(spark, path)
    return held["nation"].join(held["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


# Rules and expressions. Their SQL lists what each comes to.

_SIMPLE = [("(x + 0) * 1", "x"), ("(x * 0) + (2 * 3)", "6"), ("((x * 1) + 0) * (2 - 2)", "0"), ("(y - y) + z", "z")]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SIMPLE) + ") AS t(expression, simple)")
def saturation(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest forms by equality saturation."""
    return spark.createDataFrame([(a, str(egraph.simplify(egraph.parse(a)))) for a, _ in _SIMPLE], "expression string, simple string")


_PAIRS = [("(x + 0) * 1", "x", True), ("x + y", "y + x", True), ("x + 1", "x + 2", False), ("x * x", "x + x", False)]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in _PAIRS) + ") AS t(before, after, equal)")
def translation_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs by saturation, counterexamples by a search on Spark."""
    rows = [(a, b, validate.validate(spark, egraph.parse(a), egraph.parse(b)).equal) for a, b, _ in _PAIRS]
    return spark.createDataFrame(rows, "before string, after string, equal boolean")


@_query("SELECT * FROM (VALUES ('access', ''), ('boolean', ''), ('counting', ''), ('fuzzy', ''), ('probabilistic', 'times distributes'), ('tropical', '')) AS t(ring, broken)")
def semiring_laws(spark: SparkSession, sf: str) -> DataFrame:
    """Which laws fail on samples; the probabilistic weights do not distribute."""
    samples = {"counting": [-5, -1, 0, 1, 7], "tropical": [0.0, 1.5, 10.0, float("inf")], "boolean": [True, False], "fuzzy": [0.0, 0.4, 1.0], "probabilistic": [0.0, 0.5, 1.0], "access": [0, 1, 2, 3]}
    return spark.createDataFrame([(n, ", ".join(semiring.broken_laws(r, samples[n]))) for n, r in sorted(semiring.SEMIRINGS.items())], "ring string, broken string")


_RULES = [("p(X) :- a(X, Y), b(Y, Z), a(X, Y), X > 2 + 3.", "a(X, Y), X > 5, b(Y, Z)"), ("p(X) :- b(Y, Z), a(X, Y).", "b(Y, Z), a(X, Y)")]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ") AS t(rule, body)")
def rule_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Folded constants, repeated literals taken out, comparisons moved to where they can be decided."""
    return spark.createDataFrame([(a, ", ".join(map(str, rewrite.simplify(parse(a).rules[0]).body))) for a, _ in _RULES], "rule string, body string")


@_query("SELECT * FROM (VALUES ('apart', 1, 'bigint,bigint'), ('path', 0, 'bigint,bigint'), ('v', 0, 'bigint')) AS t(predicate, stratum, types)")
def program_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Strata and inferred types of a program with negation over recursion."""
    program = parse("edge(1, 2). path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). v(X) :- edge(X, _). apart(X, Y) :- v(X), v(Y), not path(X, Y).")
    types = analysis.infer_types(program)
    rows = [(p, k, ",".join(types[p])) for k, found in enumerate(analysis.strata(program)) for p in found]
    return spark.createDataFrame(rows, "predicate string, stratum int, types string")
