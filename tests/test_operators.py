from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import lattice, semiring
from weftline.functions.histogram import Histogram, distinct_estimate
from weftline.functions.lattice import Antichain, FrontierTracker, Time
from weftline.functions.semiring import COUNTING, SEMIRINGS, TROPICAL, Polynomial
from weftline.operators import graph, temporal, zset
from weftline.sources import storage


def rows(df):
    return sorted(map(tuple, df.collect()))


SAMPLES = {"counting": [-5, -1, 0, 1, 7], "tropical": [0.0, 1.5, 10.0, math.inf], "boolean": [True, False], "fuzzy": [0.0, 0.4, 0.8, 1.0], "probabilistic": [0.0, 0.5, 1.0], "access": [0, 1, 2, 3]}


@pytest.mark.parametrize("name", sorted(SEMIRINGS))
def test_semiring_laws(name):
    assert semiring.broken_laws(SEMIRINGS[name], SAMPLES[name]) == (["times distributes"] if name == "probabilistic" else [])


def test_semirings_on_columns_agree_with_values(spark):
    for name, ring in SEMIRINGS.items():
        pairs = [(a, b) for a in SAMPLES[name] for b in SAMPLES[name]]
        df = spark.createDataFrame(pairs, f"a {ring.type}, b {ring.type}")
        got = df.select("a", "b", ring.times_col(F.col("a"), F.col("b")).alias("t")).collect()
        assert all(r["t"] == pytest.approx(ring.times(r["a"], r["b"])) for r in got)
        total = ring.zero
        for v in SAMPLES[name]:
            total = ring.plus(total, v)
        one = spark.createDataFrame([(v,) for v in SAMPLES[name]], f"a {ring.type}")
        assert one.agg(ring.plus_agg(F.col("a"))).first()[0] == pytest.approx(total)


def test_polynomials():
    e1, e2, e3 = map(Polynomial.variable, ("e1", "e2", "e3"))
    p = (e1 + e2) * e3
    assert p.evaluate({"e1": 1, "e2": 2, "e3": 3}) == 9
    assert p.holds({"e1", "e3"}) and not p.holds({"e1", "e2"})
    assert p.witnesses() == {frozenset({"e1", "e3"}), frozenset({"e2", "e3"})}
    assert p.derivative("e1") == e3
    assert (e1 * e1).derivative("e1") == Polynomial.constant(2) * e1


def test_times(spark):
    a, b = Time(3, 1, 5), Time(1, 4, 2)
    assert a.join(b) == Time(3, 4, 5) and a.meet(b) == Time(1, 1, 2) and a.concurrent(b)
    assert Time(1, 0) == Time(1) and hash(Time(1, 0)) == hash(Time(1)) and Time(1, 2).before(Time(1, 3))
    chain = Antichain()
    sizes = []
    for t in (Time(2, 2), Time(3, 3), Time(1, 4), Time(1, 1)):
        chain.insert(t)
        sizes.append(len(chain.times))
    assert sizes == [1, 1, 2, 1] and chain.past(Time(0, 5)) and not chain.past(Time(2, 1))
    tracker = FrontierTracker()
    for t, n in ((Time(1), 2), (Time(2), 1), (Time(1), -2)):
        tracker.update(t, n)
    assert tracker.frontier().times == {Time(2)}
    df = spark.createDataFrame([([3, 1, 5], [1, 4, 2, 0])], "a array<bigint>, b array<bigint>")
    got = df.select(lattice.join(F.col("a"), F.col("b")), lattice.meet(F.col("a"), F.col("b")), lattice.concurrent(F.col("a"), F.col("b"))).first()
    assert tuple(got) == ([3, 4, 5], [1, 1, 2], True)


def test_antijoin_life_cycle(spark):
    a = zset.lift(spark.createDataFrame([(10, "Bob")], "user_id long, name string"), epoch=1)
    none = spark.createDataFrame([], "user_id long")
    plus = zset.lift(spark.createDataFrame([(10,)], "user_id long"), epoch=2)
    minus, empty, no_a = zset.negate(plus), zset.lift(none), a.limit(0)
    assert rows(zset.antijoin_delta(no_a, a, empty, empty, ["user_id"])) == [(10, "Bob", 1)]
    assert rows(zset.antijoin_delta(a, no_a, empty, plus, ["user_id"])) == [(10, "Bob", -1)]
    assert rows(zset.antijoin_delta(a, no_a, plus, minus, ["user_id"])) == [(10, "Bob", 1)]


def test_join_and_aggregate_changes_sum_to_the_whole(spark):
    def d(data, schema):
        return zset.lift(spark.createDataFrame(data, schema), epoch=1)

    a0, a1 = d([(1, "x"), (2, "y")], "k long, a string"), d([(1, "z"), (None, "n")], "k long, a string")
    b0, b1 = d([(1, 10.0)], "k long, b double"), d([(2, 20.0), (None, 5.0)], "k long, b double")
    whole = zset.join(a0.union(a1), b0.union(b1), ["k"])
    parts = zset.join(a0, b0, ["k"]).union(zset.join_delta(a0, a1, b0, b1, ["k"]))
    key = lambda df: sorted(map(str, zset.consolidate(df).collect()))
    assert key(whole) == key(parts)
    before, change = d([("u", "a"), ("u", "b")], "u string, e string"), d([("u", "c")], "u string, e string")
    assert rows(zset.aggregate_delta(before, change, ["u"], n=("count", None))) == [("u", 2, -1), ("u", 3, 1)]
    three = d([("k", 10.0), ("k", 20.0), ("k", 30.0), ("k", None)], "k string, v double")
    assert rows(zset.aggregate(three, ["k"], m=("mean", "v"), v=("variance", "v"), h=("median", "v"), lo=("min", "v"))) == [("k", 20.0, 100.0, 20.0, 10.0)]


def test_consolidate_as_of_compact(spark):
    t = lambda e, page, w: zset.lift(spark.createDataFrame([(page,)], "p string"), epoch=e, weight=w)
    trace = t(1, "home", 1).union(t(2, "cart", 1)).union(t(3, "home", -1))
    assert [rows(zset.as_of(trace, [e])) for e in (1, 2, 3)] == [[("home", 1)], [("cart", 1), ("home", 1)], [("cart", 1)]]
    assert rows(zset.as_of(zset.compact(trace, [2]), [3])) == [("cart", 1)]
    assert [(r["p"], list(r["__t"])) for r in zset.ordered(trace).collect()] == [("cart", [2]), ("home", [1]), ("home", [3])]


def test_windows_sessions_sequences(spark):
    one = spark.range(1)
    pairs = lambda c: [tuple(w) for w in one.select(c.alias("w")).first()["w"]]
    assert pairs(temporal.sliding(F.lit(7), 10, 5)) == [(0, 10), (5, 15)]
    assert pairs(temporal.sliding(F.lit(9), 10, 4)) == [(0, 10), (4, 14), (8, 18)]
    assert pairs(temporal.sliding(F.lit(3), 10, 5)) == [(-5, 5), (0, 10)] and pairs(temporal.sliding(F.lit(3), 10, 5, from_zero=True)) == [(0, 10)]
    assert tuple(one.select(temporal.tumbling(F.lit(-3), 10).alias("w")).first()["w"]) == (-10, 0)
    at = lambda *ts: spark.createDataFrame([("alice", t) for t in ts], "u string, t long")
    assert rows(temporal.sessions(at(100, 150, 500), ["u"], "t", 100)) == [("alice", 100, 150, 2), ("alice", 500, 500, 1)]
    assert rows(temporal.sessions(at(100, 150, 500, 230, 320, 420), ["u"], "t", 100)) == [("alice", 100, 500, 6)]
    got = temporal.interval_join(at(1000), at(949, 950, 1050, 1100, 1101), ["u"], "t", "t", 50, 100)
    assert sorted(r["r_t"] for r in got.collect()) == [950, 1050, 1100]
    log = spark.createDataFrame([("u", "login", 10), ("u", "withdraw", 50), ("u", "withdraw", 200)], "u string, k string, t long")
    assert rows(temporal.followed_by(log, ["u"], "t", F.col("k") == "login", F.col("k") == "withdraw", 100)) == [("u", 10, 50)]
    h, p = temporal.Holds(["u"], "t"), F.col("k") == "withdraw"
    assert rows(log.select("t", h.next(p), h.always(p, 200), h.eventually(p, 30))) == [(10, True, False, False), (50, True, True, True), (200, False, True, True)]


def test_sessions_and_sequences_across_slices_of_time(spark):
    """Slices narrower and wider than sessions, null keys, ties and negative times give what one pass over each key gives."""
    import random

    rng = random.Random(8)
    log = [(rng.choice(["a", "b", None]), rng.randrange(-300, 300), rng.choice("xyz")) for _ in range(400)]
    df = spark.createDataFrame([*log, ("a", None, "x")], "u string, t long, k string")
    for gap, slices in ((3, 1), (3, 2), (0, 1), (7, 256)):
        want = []
        for u in ("a", "b", None):
            run = None
            for t in sorted(t for v, t, _ in log if v == u):
                if run is None or t - run[1] > gap:
                    run = [t, t, 0]
                    want.append((u, run))
                run[1], run[2] = t, run[2] + 1
        got = temporal.sessions(df, ["u"], "t", gap, slice_gaps=slices)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((u, *r)) for u, r in want)
    for within in (0, 2, 9):
        want = []
        for i, (u, t, k) in enumerate(log):
            ends = [s for j, (v, s, m) in enumerate(log) if v == u and m == "y" and t <= s <= t + within and i != j]
            if k == "x" and ends:
                want.append((u, t, min(ends)))
        got = temporal.followed_by(df, ["u"], "t", F.col("k") == "x", F.col("k") == "y", within)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_segment_tree(spark):
    tree, least = temporal.SegmentTree(8, COUNTING), temporal.SegmentTree(8, TROPICAL)
    for i, v in enumerate((10, 20, 30, 40, 50)):
        tree.update(i, v)
    for i, v in enumerate((5.0, 2.0, 8.0, 1.0, 9.0)):
        least.update(i, v)
    assert (tree.query(0, 2), tree.query(1, 3), tree.total(), tree.query(3, 1)) == (60, 90, 150, 0)
    tree.update(2, 5)
    assert (tree.query(0, 2), tree.total(), least.query(0, 2), least.query(0, 4)) == (35, 125, 2.0, 1.0)
    df = spark.createDataFrame([(i, v) for i, v in enumerate((10, 20, 30))], "i long, v long")
    assert temporal.range_sum(df, "i", "v", 1, 2, COUNTING).first()[0] == 50


def test_histogram_and_sketch(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    h = Histogram.of(df, "v", 10, 0.0, 100.0)
    assert abs(h.at_most(50) - 0.5) < 0.05 and h.total == 101 and h.at_most(-1) == 0 and h.between(20, 40) == pytest.approx(0.2, abs=0.03)
    assert abs(distinct_estimate(spark.range(5000), "id") - 5000) < 500


def test_graph(spark):
    v = spark.createDataFrame([(1, ["User", "Admin"], {}), (2, ["User"], {}), (3, ["Server"], {})], "id long, labels array<string>, properties map<string,string>")
    e = spark.createDataFrame([(1, 1, 2, "KNOWS", {"weight": "2.5"}), (2, 2, 3, "CONNECTS_TO", {})], "id long, src long, dst long, label string, properties map<string,string>")
    g = graph.PropertyGraph(v, e)
    assert sorted(r["id"] for r in g.with_label("User").collect()) == [1, 2] and g.counts() == (3, 2) and g.out(1).count() == g.into(3).count() == 1
    assert rows(g.weighted()) == [(1, 2, 2.5), (2, 3, 1.0)]
    assert rows(graph.path_pattern(g, [("a", "User"), ("b", None), ("c", "Server")], ["KNOWS", None])) == [(1, 3)]
    assert len(graph.path_rule("p", [("U", "Person"), ("V", None), ("W", "Person")], ["FRIEND", "FRIEND"]).head.args) == 2
    with pytest.raises(ValueError, match="no vertex"):
        graph.PropertyGraph(v.where("id < 3"), e)
    w = spark.createDataFrame([(1, 2, 1.0), (2, 4, 2.0), (1, 3, 4.0), (3, 4, 1.0)], "src long, dst long, w double")
    assert rows(graph.shortest_paths(w, 1)) == [(1, 0.0), (2, 1.0), (3, 4.0), (4, 3.0)]
    assert rows(graph.k_hops(w, 1, 1)) == [(1,), (2,), (3,)]
    assert (1, 4, 2.0) in rows(graph.all_pairs(w)) and (1, 4, 3.0) in rows(graph.all_pairs(w, weighted=True))
    two = spark.createDataFrame([(a, b) for t in ((1, 2, 3), (4, 5, 6)) for a in t for b in t if a != b] + [(3, 4), (4, 3)], "src long, dst long")
    assert rows(graph.label_propagation(two)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    assert max(rows(graph.page_rank(ring)), key=lambda r: r[1])[0] == 1


def test_taint(spark):
    tx = spark.createDataFrame([("tx1", "A", "B"), ("tx2", "B", "C"), ("tx3", "C", "D")], "id string, src string, dst string")
    t = graph.taint(tx, "A")
    last = [r for r in t.collect() if r["account"] == "D"][0]
    assert last["mono"] == {"source_A": 1, "tx1": 1, "tx2": 1, "tx3": 1} and last["coeff"] == 1
    assert dict(rows(graph.sensitivity(t, "tx1", {"tx2": 3.0})))["D"] == 3.0


def test_storage(spark, tmp_path):
    log = storage.ChangeLog(spark, f"file://{tmp_path}/log")
    records = [(1, "p", (1, "a"), 1), (2, "p", (2, "b"), 1), (3, "p", (1, "a"), -1)]
    log.append(records)
    assert [(r["epoch"], r["weight"]) for r in log.replay().collect()] == [(1, 1), (2, 1), (3, -1)]
    assert rows(log.state("p", "id long, n string")) == [(2, "b")] and log.state("p", "id long, n string", 2).count() == 2
    bad = spark.createDataFrame([(4, 0, "p", "[3]", 1, 12345)], storage.SCHEMA)
    bad.write.mode("append").parquet(log.path)
    with pytest.raises(storage.CorruptLog):
        log.replay()
    assert storage.load_snapshot(spark, f"file://{tmp_path}/none") == {}
    storage.save_snapshot(f"file://{tmp_path}/snap", {"users": spark.createDataFrame([(1, "x")], "id long, n string")})
    assert rows(storage.load_snapshot(spark, f"file://{tmp_path}/snap")["users"]) == [(1, "x")]
    c = storage.Catalog(spark)
    c.register(storage.Relation("employee", (("id", "bigint"), ("name", "string"), ("salary", "double"))))
    assert c.get("employee").arity == 3 and c.has("employee") and len(c.all()) == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from weftline import session

    settings = SimpleNamespace(get=lambda *_: None)
    context = lambda master: SimpleNamespace(master=master, getConf=lambda: settings)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(SimpleNamespace(sparkContext=context(master), conf=settings))


def test_scratch_leaves_no_shuffle_files_and_no_setting(spark):
    from weftline import session

    was = spark.conf.get(session.CLEANUP)
    out = session.scratch(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "kept")
    assert out.count() == 10 and spark.conf.get(session.CLEANUP) == was
    session.drop_scratch(spark, out)
    assert out._scratch not in session._made


def test_taint_and_hops_work_their_edges_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    e = spark.createDataFrame([("t1", 1, 2), ("t2", 2, 3), ("t3", 3, 4), ("t4", 2, 4)], "id string, src long, dst long")
    found = graph.taint(e.mapInArrow(told, e.schema), 1, max_hops=3)
    assert rows(graph.sensitivity(found, "t2", {})) == [(1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0)]
    assert seen.value == 4
    assert rows(graph.k_hops(e.mapInArrow(told, e.schema), 1, 3)) == [(1,), (2,), (3,), (4,)]
    assert seen.value == 8


def test_trade_reads_its_tables_once(spark):
    """What the two cheapest sellers of each nation are is written once, whoever reads it and how often."""
    from weftline.queries import trade

    t = trade(spark, "/root/testdata/sf0.001")
    assert all("scratch" in f or "weftline" in f for f in t.inputFiles()) and "lineitem" not in str(t._jdf.queryExecution().optimizedPlan())
