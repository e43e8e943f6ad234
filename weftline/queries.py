"""Registered queries over the test tables, one for each operator group, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import histogram as sketch
from weftline.functions import semiring
from weftline.functions.histogram import Histogram
from weftline.operators import graph, temporal, zset
from weftline.plans import sql
from weftline.plans.engine import Engine, evaluate_closure
from weftline.session import scratch, scratch_path
from weftline.sources.storage import ChangeLog
from weftline.streaming import windows
from weftline.streaming.incremental import Maintained


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: _t(spark, sf, n) for n in names}


def _program(spark: SparkSession, sf: str, text: str, tables: dict[str, list[str] | DataFrame], what: str, columns: list[str], **how) -> DataFrame:
    """A program over tables cut to the columns named; the predicate's rows under the given column names."""
    given = {n: c if isinstance(c, DataFrame) else _t(spark, sf, n).select(*c) for n, c in tables.items()}
    return Engine(spark, text, given).query(what, **how).toDF(*columns)


# Rules: joins, comparisons, arithmetic, union, negation, aggregates.


@_query("SELECT DISTINCT c_name AS name, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'")
def rule_join(spark: SparkSession, sf: str) -> DataFrame:
    """Equi-join, constant in a second place, comparison, head projection."""
    text = 'hv(N, A) :- customer(K, N, "BUILDING"), orders(K, A), A > 200000.'
    return _program(spark, sf, text, {"customer": ["c_custkey", "c_name", "c_mktsegment"], "orders": ["o_custkey", "o_totalprice"]}, "hv", ["name", "price"])


@_query("""SELECT DISTINCT s_name AS supplier, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name != 'ASIA'""")
def rule_multiway_join(spark: SparkSession, sf: str) -> DataFrame:
    text = 'place(S, N, R) :- supplier(_, S, NK, _), nation(NK, N, RK), region(RK, R), R != "ASIA".'
    return _program(spark, sf, text, {"supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"]}, "place", ["supplier", "nation", "region"])


@_query("SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def rule_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return _program(spark, sf, "near(A, B) :- nation(K, A, R), nation(L, B, R), K < L.", {"nation": ["n_nationkey", "n_name", "n_regionkey"]}, "near", ["a", "b"])


@_query("SELECT DISTINCT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey >= b.r_regionkey")
def rule_theta_join(spark: SparkSession, sf: str) -> DataFrame:
    return _program(spark, sf, "pair(A, B) :- region(K, A), region(L, B), K >= L.", {"region": ["r_regionkey", "r_name"]}, "pair", ["a", "b"])


@_query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def rule_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Negation over a derived relation."""
    text = 'urgent(K) :- orders(K, "F", "1-URGENT"). calm(K) :- customer(K), not urgent(K).'
    return _program(spark, sf, text, {"customer": ["c_custkey"], "orders": ["o_custkey", "o_orderstatus", "o_orderpriority"]}, "calm", ["id"])


@_query("SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 9000)")
def rule_union(spark: SparkSession, sf: str) -> DataFrame:
    text = "rich(N) :- customer(N, B), B > 9000. rich(N) :- supplier(N, B), B > 9000."
    return _program(spark, sf, text, {"customer": ["c_name", "c_acctbal"], "supplier": ["s_name", "s_acctbal"]}, "rich", ["name"])


@_query("""SELECT DISTINCT p_partkey AS id, CAST(p_size * 2 + 1 AS BIGINT) AS grown, CAST(100 // p_size AS BIGINT) AS part, CAST(p_size % 7 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS nought FROM part WHERE p_size + 5 > 30""")
def rule_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    text = "a(K, S * 2 + 1, 100 / S, S mod 7, S / (3 - 3)) :- part(K, S), S + 5 > 30."
    part = _t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long"))
    return _program(spark, sf, text, {"part": part}, "a", ["id", "grown", "part", "rest", "nought"])


@_query("""WITH o AS (SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM orders)
SELECT o_custkey AS id, count(*) AS n, max(o_totalprice) AS most, min(o_totalprice) AS least, median(o_totalprice) AS middle FROM o GROUP BY o_custkey""")
def rule_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    text = """s(K, N, H, L, M) :- n(K, N), h(K, H), l(K, L), m(K, M).
    n(K, N) :- orders(_, K, _), N = count<O>(orders(O, K, _)). h(K, H) :- orders(_, K, _), H = max<P>(orders(_, K, P)).
    l(K, L) :- orders(_, K, _), L = min<P>(orders(_, K, P)). m(K, M) :- orders(_, K, _), M = median<P>(orders(_, K, P))."""
    return _program(spark, sf, text, {"orders": ["o_orderkey", "o_custkey", "o_totalprice"]}, "s", ["id", "n", "most", "least", "middle"])


@_query("SELECT l_returnflag AS flag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def aggregate_mean_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted aggregates of a Z-set, each row with weight 1."""
    d = zset.lift(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), "l_quantity"))
    out = zset.aggregate(d, ["flag"], mean=("mean", "l_quantity"), variance=("variance", "l_quantity"))
    return out.select("flag", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


# Recursion.

_CHAIN = """WITH RECURSIVE e AS (SELECT n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation),
e2 AS (SELECT * FROM e WHERE b IS NOT NULL), tc(a, b) AS (SELECT a, b FROM e2 UNION SELECT tc.a, e2.b FROM tc JOIN e2 ON tc.b = e2.a)"""


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.lead("n_nationkey").over(w).alias("b")).where("b IS NOT NULL")


_TRADE = """t AS (SELECT c_nationkey AS a, s_nationkey AS b, min(l_extendedprice) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w, b) AS r FROM t) WHERE r <= 2)"""


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, w: for each nation the two nations that it buys cheapest from; has cycles.

    A scratch table of two rows a nation, as most queries read it more than once. Orders meet their customers before the
    lines, which are shuffled once.
    """
    o, c, s = _t(spark, sf, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf, "customer").select("c_custkey", "c_nationkey"), _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    sold = li.join(s, F.col("l_suppkey") == s.s_suppkey).select("l_orderkey", "s_nationkey", "l_extendedprice")
    bought = o.join(c, F.col("o_custkey") == c.c_custkey).select("o_orderkey", "c_nationkey")
    t = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey")
    t = t.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.min("l_extendedprice").alias("w"))
    return scratch(t.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("w", "b"))).where("r <= 2").drop("r"), "trade")


@_query(_CHAIN + " SELECT a, b FROM tc")
def closure_acyclic(spark: SparkSession, sf: str) -> DataFrame:
    return _program(spark, sf, "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", {"edge": _chain(spark, sf)}, "path", ["a", "b"])


@_query(f"WITH RECURSIVE {_TRADE}, tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a, b FROM tc")
def closure_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """Squaring over a graph with cycles."""
    return _program(spark, sf, "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), path(Y, Z).", {"edge": trade(spark, sf).select("a", "b")}, "path", ["a", "b"])


@_query(f"WITH RECURSIVE {_TRADE}, r(n) AS (SELECT 0 UNION SELECT e.b FROM r JOIN e ON r.n = e.a) SELECT n FROM r")
def recursion_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Semi-naive recursion from a fact."""
    edge = trade(spark, sf).select(F.col("a").cast("long"), F.col("b").cast("long"))
    return _program(spark, sf, "reach(0). reach(Y) :- reach(X), edge(X, Y).", {"edge": edge}, "reach", ["n"]).select(F.col("n").cast("int").alias("n"))


@_query(f"WITH RECURSIVE {_TRADE}, tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a), v AS (SELECT a AS n FROM e UNION SELECT b FROM e) SELECT x.n AS a, y.n AS b FROM v x, v y WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.a = x.n AND tc.b = y.n)")
def negated_recursion(spark: SparkSession, sf: str) -> DataFrame:
    text = "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z). v(X) :- edge(X, _). v(Y) :- edge(_, Y). apart(X, Y) :- v(X), v(Y), not path(X, Y)."
    return _program(spark, sf, text, {"edge": trade(spark, sf).select("a", "b")}, "apart", ["a", "b"])


@_query(f"WITH RECURSIVE {_TRADE}, r(n) AS (SELECT b FROM e WHERE a = 3 UNION SELECT e.b FROM r JOIN e ON r.n = e.a) SELECT n FROM r")
def magic_sets_reach(spark: SparkSession, sf: str) -> DataFrame:
    """path(3, Y) by magic sets: only what starts at 3 is derived."""
    edge = trade(spark, sf).select(F.col("a").cast("long"), F.col("b").cast("long"))
    return _program(spark, sf, "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", {"edge": edge}, "path(3, Y)", ["n"], magic=True).select(F.col("n").cast("int").alias("n"))


@_query(f"WITH RECURSIVE {_TRADE}, p(n, k) AS (SELECT 0, 0 UNION SELECT e.b, 1 - p.k FROM p JOIN e ON p.n = e.a) SELECT n, CAST(k AS BIGINT) AS odd FROM p")
def mutual_recursion(spark: SparkSession, sf: str) -> DataFrame:
    edge = trade(spark, sf).select(F.col("a").cast("long"), F.col("b").cast("long"))
    text = "even(0). even(Y) :- odd(X), edge(X, Y). odd(Y) :- even(X), edge(X, Y). p(X, 0) :- even(X). p(X, 1) :- odd(X)."
    return _program(spark, sf, text, {"edge": edge}, "p", ["n", "odd"]).select(F.col("n").cast("int").alias("n"), "odd")


# SQL dialect.


@_query("SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS most FROM customer JOIN orders ON c_custkey = o_custkey WHERE NOT o_orderstatus = 'P' OR o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 10")
def sql_group_having(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT c.c_mktsegment AS segment, COUNT(*) AS n, MAX(o.o_totalprice) AS most FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE NOT o.o_orderstatus = 'P' OR o.o_totalprice > 100000 GROUP BY c.c_mktsegment HAVING COUNT(*) > 10"
    return sql.run(spark, text, _tables(spark, sf, "customer", "orders"))


@_query("SELECT DISTINCT s_name AS name, n_name AS nation, s_acctbal * 2 AS twice FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def sql_join(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT s.s_name AS name, n.n_name AS nation, s.s_acctbal * 2 AS twice FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0"
    return sql.run(spark, text, _tables(spark, sf, "supplier", "nation"))


@_query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sql_top(spark: SparkSession, sf: str) -> DataFrame:
    return sql.run(spark, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 20", _tables(spark, sf, "orders"))


# Weighted relations.

_SPLIT = "CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END"


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items in two epochs; the second takes back each order's first line."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = zset.lift(li.where("l_linenumber <= 3"), epoch=1)
    second = zset.lift(li.where("l_linenumber > 3"), epoch=2).unionByName(zset.lift(li.where("l_linenumber = 1"), epoch=2, weight=-1))
    return first.unionByName(second)


@_query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <> 1")
def zset_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return zset.as_of(_epochs(spark, sf), [2]).where("__w > 0").drop("__w")


@_query("SELECT l_orderkey AS id, CAST(sum(CASE WHEN l_linenumber <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS w FROM lineitem GROUP BY 1 HAVING w <> 0")
def zset_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    d = _epochs(spark, sf).select(F.col("l_orderkey").alias("id"), "__t", "__w")
    return zset.consolidate(zset.compact(d, [2]), times=False).select("id", F.col("__w").alias("w"))


@_query("SELECT o_orderkey AS id, l_partkey AS part, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 2 GROUP BY 1, 2")
def zset_join_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The join of two relations that both grow: the first state's join and its changes, summed."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), "l_linenumber")
    a0, a1 = zset.lift(o.where("o_orderpriority <> '1-URGENT'").select("id"), epoch=1), zset.lift(o.where("o_orderpriority = '1-URGENT'").select("id"), epoch=2)
    b0, b1 = zset.lift(li.where("l_linenumber = 2").select("id", "part"), epoch=1), zset.lift(li.where("l_linenumber = 1").select("id", "part"), epoch=2)
    whole = zset.join(a0, b0, ["id"]).unionByName(zset.join_delta(a0, a1, b0, b1, ["id"]))
    return zset.consolidate(whole, times=False).select("id", "part", F.col("__w").alias("w"))


@_query("""SELECT c_custkey AS id, CAST(CASE WHEN u THEN -1 ELSE 1 END AS BIGINT) AS w FROM (SELECT c_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(coalesce(o_orderstatus, '') = 'P') AS u FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) WHERE NOT coalesce(f, false) AND u""")
def zset_antijoin_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that stop being without orders when orders of status P are added to those of status F."""
    c = zset.lift(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), epoch=1)
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    f, p = (zset.lift(o.where(F.col("o_orderstatus") == s).select("id"), epoch=e) for s, e in (("F", 1), ("P", 2)))
    return zset.antijoin_delta(c, c.limit(0), f, p, ["id"]).select("id", F.col("__w").alias("w"))


@_query("""WITH a AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT id, n, CAST(-1 AS BIGINT) AS w FROM a JOIN t USING (id) UNION ALL SELECT id, n, CAST(1 AS BIGINT) FROM b JOIN t USING (id)""")
def zset_aggregate_delta(spark: SparkSession, sf: str) -> DataFrame:
    o = zset.lift(_t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus"))
    out = zset.aggregate_delta(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), ["id"], n=("count", None))
    return out.select("id", "n", F.col("__w").alias("w"))


@_query(f"WITH RECURSIVE {_TRADE}, tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a, b FROM tc")
def incremental_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A closure kept up through an insert and a retraction; ends at the closure of all edges."""
    e = trade(spark, sf).select("a", "b")
    m = Maintained(spark, "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", {"edge": e.where("a <> 3")})
    m.apply("edge", e.where("a = 3"))
    m.apply("edge", e.where("a = 5").withColumn("w", F.lit(-1)), "w")
    m.apply("edge", e.where("a = 5"))
    return m.state["path"].toDF("a", "b")


# Weight algebras.


@_query("SELECT o_orderpriority AS k, min(o_totalprice) AS tropical, max(o_totalprice / 1000000) AS fuzzy, bool_or(o_orderstatus = 'P') AS boolean, CAST(count(*) AS BIGINT) AS counting FROM orders GROUP BY 1")
def semiring_sums(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    s = semiring
    return o.groupBy(F.col("o_orderpriority").alias("k")).agg(
        s.TROPICAL.plus_agg(F.col("o_totalprice")).alias("tropical"), s.FUZZY.plus_agg(F.col("o_totalprice") / 1000000).alias("fuzzy"), s.BOOLEAN.plus_agg(F.col("o_orderstatus") == "P").alias("boolean"), s.COUNTING.plus_agg(F.lit(1)).alias("counting")
    )


@_query("SELECT c_nationkey AS nation, round(1 - exp(sum(ln(1 - o_totalprice / 10000000))), 6) AS p FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def semiring_probability(spark: SparkSession, sf: str) -> DataFrame:
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    p = semiring.PROBABILISTIC.plus_agg(F.col("o_totalprice") / 10000000)
    return c.join(o, c.c_custkey == o.o_custkey).groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(p, 6).alias("p"))


@_query(f"WITH {_TRADE}, h2 AS (SELECT x.a || '>' || x.b || '*' || y.a || '>' || y.b AS m FROM e x JOIN e y ON x.b = y.a WHERE x.a = 3) SELECT m, CAST(count(*) AS BIGINT) AS coeff FROM (SELECT CASE WHEN split_part(m, '*', 1) < split_part(m, '*', 2) THEN m ELSE split_part(m, '*', 2) || '*' || split_part(m, '*', 1) END AS m FROM h2) GROUP BY m")
def provenance_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Polynomials in long form: the monomials of two hops from nation 3."""
    e = trade(spark, sf).select("a", "b", semiring.monomial(F.concat_ws(">", "a", "b")).alias("m"))
    f = e.toDF("b", "c", "n")
    out = e.where("a = 3").join(f, "b").select(semiring.monomial_text(semiring.monomial_times(F.col("m"), F.col("n"))).alias("m"))
    return out.groupBy("m").agg(F.count("*").alias("coeff"))


# Time.

_MS = "(epoch_us(ts) // 1000)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))


@_query(f"SELECT {_MS} // 3600000 * 3600000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("w", temporal.tumbling(F.col("t"), 3_600_000))
    return e.groupBy(F.col("w.start").alias("start"), "event_type").agg(F.count("*").alias("n"))


@_query(f"SELECT t // 3600000 * 3600000 - k * 3600000 AS start, count(*) AS n FROM (SELECT {_MS} AS t FROM events), (VALUES (0), (1), (2)) AS v(k) GROUP BY 1")
def window_sliding(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("w", F.explode(temporal.sliding(F.col("t"), 3 * 3_600_000, 3_600_000)))
    return e.groupBy(F.col("w.start").alias("start")).agg(F.count("*").alias("n"))


_SESSIONS = f"""WITH e AS (SELECT user_id, {_MS} AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 7200000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS events FROM s GROUP BY user_id, s"""


@_query(_SESSIONS)
def session_batch(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.sessions(_events(spark, sf), ["user_id"], "t", 7_200_000)


@_query(_SESSIONS)
def session_window_form(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming form on a batch."""
    out = windows.session_counts(_t(spark, sf, "events"), "ts", "2 hours", ["user_id"])
    return out.select("user_id", F.unix_millis("start").alias("start"), F.unix_millis("end").alias("end"), "events")


@_query(f"SELECT c.event_id AS click, p.event_id AS purchase FROM (SELECT *, {_MS} AS t FROM events) c JOIN (SELECT *, {_MS} AS t FROM events) p ON c.user_id = p.user_id AND p.t BETWEEN c.t - 3600000 AND c.t + 3600000 WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    out = temporal.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "t", "t", 3_600_000, 3_600_000)
    return out.select(F.col("event_id").alias("click"), F.col("r_event_id").alias("purchase"))


@_query(f"""WITH e AS (SELECT *, {_MS} AS t FROM events) SELECT a.user_id, a.t AS start, min(b.t) AS "end" FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t AND a.t + 86400000 WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY a.user_id, a.event_id, a.t""")
def followed_by(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.followed_by(_events(spark, sf), ["user_id"], "t", F.col("event_type") == "signup", F.col("event_type") == "purchase", 86_400_000)


@_query(f"""WITH e AS (SELECT event_id, user_id, {_MS} AS t, event_type = 'view' AS p FROM events)
SELECT event_id, coalesce(lead(p) OVER (PARTITION BY user_id ORDER BY t), false) AS nxt, min(p::INT) OVER w = 1 AS alw, max(p::INT) OVER w = 1 AS ev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 36000000 FOLLOWING)""")
def temporal_logic(spark: SparkSession, sf: str) -> DataFrame:
    h, p = temporal.Holds(["user_id"], "t"), F.col("event_type") == "view"
    return _events(spark, sf).select("event_id", h.next(p).alias("nxt"), h.always(p, 36_000_000).alias("alw"), h.eventually(p, 36_000_000).alias("ev"))


@_query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY {_MS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_sum(spark: SparkSession, sf: str) -> DataFrame:
    out = temporal.rolling(_events(spark, sf), ["user_id"], "t", "value", 4, semiring.COUNTING)
    return out.select("event_id", F.round("rolling", 6).alias("rolling"))


# Graphs over the nations' trade.


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


_HOPS = "pairs(a, b, d) AS (SELECT a, a, 0 FROM (SELECT a FROM e UNION SELECT b FROM e) UNION SELECT p.a, e.b, p.d + 1 FROM pairs p JOIN e ON p.b = e.a WHERE p.d < 25)"


@_query(f"WITH RECURSIVE {_TRADE}, p(n, d, k) AS (SELECT 3, CAST(0.0 AS DOUBLE), 0 UNION SELECT n, min(d), k FROM (SELECT e.b AS n, p.d + e.w AS d, p.k + 1 AS k FROM p JOIN e ON p.n = e.a WHERE p.k < 25) GROUP BY n, k) SELECT n AS id, round(min(d), 4) AS dist FROM p GROUP BY n")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shortest_paths(_edges(spark, sf), 3).select("id", F.round("dist", 4).alias("dist"))


@_query(f"WITH RECURSIVE {_TRADE}, r(n, k) AS (SELECT 3, 0 UNION SELECT e.b, r.k + 1 FROM r JOIN e ON r.n = e.a WHERE r.k < 2) SELECT DISTINCT n AS id FROM r")
def k_hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.k_hops(_edges(spark, sf), 3, 2)


@_query(f"WITH RECURSIVE {_TRADE}, {_HOPS} SELECT a AS src, b AS dst, CAST(min(d) AS DOUBLE) AS dist FROM pairs GROUP BY 1, 2")
def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.all_pairs(_edges(spark, sf))


@_query(f"WITH RECURSIVE {_TRADE}, tc(a, b) AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b = e.a) SELECT a AS id FROM tc WHERE a = b")
def cycle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycle_nodes(evaluate_closure(trade(spark, sf).select(F.col("a").alias("c0"), F.col("b").alias("c1"))))


def _rank_sql(rounds: int) -> str:
    parts = [f"WITH {_TRADE}, v AS (SELECT a AS id FROM e UNION SELECT b FROM e), c AS (SELECT count(*) AS n FROM v), g AS (SELECT a, count(*) AS k FROM e GROUP BY a), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, c)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT v.id, 0.15 / any_value(c.n) + 0.85 * coalesce(sum(p.r / g.k), 0) AS r FROM v CROSS JOIN c LEFT JOIN e ON e.b = v.id LEFT JOIN r{i} p ON p.id = e.a LEFT JOIN g ON g.a = e.a GROUP BY v.id)")
    return ", ".join(parts) + f" SELECT id, round(r, 6) AS rank FROM r{rounds}"


@_query(_rank_sql(8))
def page_rank(spark: SparkSession, sf: str) -> DataFrame:
    return graph.page_rank(_edges(spark, sf), 8).select("id", F.round("rank", 6).alias("rank"))


def _labels_sql(rounds: int) -> str:
    parts = [f"WITH {_TRADE}, n AS (SELECT a AS s, b AS d FROM e UNION ALL SELECT b, a FROM e), l0 AS (SELECT DISTINCT s AS id, s AS label FROM n)"]
    for i in range(rounds):
        votes = f"SELECT n.s AS id, l.label FROM n JOIN l{i} l ON l.id = n.d WHERE n.s <> n.d UNION ALL SELECT id, label FROM l{i}"
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS r FROM ({votes}) GROUP BY 1, 2) WHERE r = 1)")
    return ", ".join(parts) + f" SELECT id, label FROM l{rounds}"


@_query(_labels_sql(6))
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, sf), 6)


@_query()
def label_propagation_in_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Vertex after vertex; tests hold it against a loop."""
    return graph.label_propagation_in_turn(_edges(spark, sf))


@_query(f"WITH RECURSIVE {_TRADE}, h(x, k) AS (SELECT 3, 0 UNION ALL SELECT e.b, h.k + 1 FROM h JOIN e ON h.x = e.a WHERE h.k < 3) SELECT x AS account, CAST(count(*) AS BIGINT) AS derivations FROM h GROUP BY x")
def taint_derivations(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).select(F.concat_ws(">", "src", "dst").alias("id"), "src", "dst")
    return graph.taint(e, 3, max_hops=3).groupBy("account").agg(F.sum("coeff").alias("derivations"))


# Statistics and sources.


@_query("SELECT CAST(least(floor((p_size - 1) / 4.9) + 1, 10) AS INT) AS bucket, count(*) AS n, round(sum(count(*)) OVER (ORDER BY least(floor((p_size - 1) / 4.9) + 1, 10)) / sum(count(*)) OVER (), 6)::DOUBLE AS up_to FROM part WHERE p_size BETWEEN 1 AND 50 GROUP BY least(floor((p_size - 1) / 4.9) + 1, 10)")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Equi-width counts, and the selectivity of being at most a bucket's upper border."""
    h = Histogram.of(_t(spark, sf, "part"), "p_size", 10, 1.0, 50.0)
    rows = [(i + 1, n, round(h.at_most(1.0 + 4.9 * (i + 1)), 6)) for i, n in enumerate(h.counts) if n]
    return spark.createDataFrame(rows, "bucket int, n long, up_to double")


_DISTINCT = {"o_custkey": "orders", "o_orderkey": "orders", "l_partkey": "lineitem", "user_id": "events", "c_nationkey": "customer"}


@_query(" UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS exact, true AS within FROM {t}" for c, t in _DISTINCT.items()))
def distinct_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """HyperLogLog estimates within a tenth of the exact counts, which stand beside."""
    rows = []
    for c, t in _DISTINCT.items():
        exact = _t(spark, sf, t).select(c).distinct().count()
        rows.append((c, exact, abs(sketch.distinct_estimate(_t(spark, sf, t), c) - exact) <= 0.1 * exact))
    return spark.createDataFrame(rows, "col string, exact long, within boolean")


@_query("SELECT o_custkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders logged with their status, those not of status F taken back in a second epoch, and the state read from the log."""
    log = ChangeLog(spark, scratch_path(spark, "log"))
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    row = F.to_json(F.array(F.col("o_custkey").cast("string"), "o_orderpriority"))
    base = o.select(F.lit(1).cast("long").alias("epoch"), F.col("o_orderkey").alias("seq"), F.lit("orders").alias("pred"), row.alias("row"), F.lit(1).cast("long").alias("weight"), "o_orderstatus")
    log.append_frame(base)
    log.append_frame(base.where("o_orderstatus <> 'F'").withColumns({"epoch": F.lit(2).cast("long"), "weight": F.lit(-1).cast("long")}))
    return log.state("orders", "id bigint, priority string")
