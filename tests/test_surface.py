"""User functions, vectors, random relations, sequential label propagation, state-store sessions, logs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline import testkit
from weftline.functions import user
from weftline.operators import columnar, graph, zset
from weftline.sources import storage
from weftline.streaming.sessions import merged


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_map_expand_filter_keep_time_and_weight(spark):
    d = zset.lift(spark.createDataFrame([("a", 4), ("b", 8), (None, None)], "k string, v long"), epoch=1, weight=3)
    doubled = user.map_rows(d, lambda r: (r[0], None if r[1] is None else r[1] * 2), "k string, v long")
    assert [tuple(r) for r in doubled.where("v > 10").collect()] == [("b", 16, [1], 3)]
    assert user.mapped(d, k="k", w=F.col("v") + 1).columns == ["k", "w", "__t", "__w"]
    spread = user.expand(d, lambda r: ((i,) for i in range(r[1] or 0)), "i long")
    assert spread.count() == 12 and spread.columns == ["i", "__t", "__w"]
    assert rows(user.filter_rows(d, lambda r: r[1] == 4).select("k", "v")) == [("a", 4)]
    assert user.map_rows(d.limit(0), lambda r: r, "k string, v long").count() == 0
    with pytest.raises(Exception, match="a row of 2 values"):
        user.map_rows(d, lambda r: (1,), "k string, v long").collect()


def test_combined_multiplies_weights_and_joins_times(spark):
    a = zset.lift(spark.createDataFrame([(1, "Alice"), (None, "Nobody")], "id long, name string"), epoch=1, weight=2)
    b = zset.lift(spark.createDataFrame([(1, "Ops"), (None, "None")], "id long, name string"), epoch=2, weight=3)
    got = user.combined(a, b, ["id"], lambda x, y: {"who": F.concat_ws("@", x("name"), y("name"))})
    assert sorted(map(tuple, got.collect())) == [("Alice@Ops", [2], 6), ("Nobody@None", [2], 6)]


def test_aggregate_of_ones_own(spark):
    """Weighted word counts: many groups, null keys, retracted rows, and a state larger than a number."""
    rng = random.Random(1)
    data = [(rng.choice(["x", "y", None]), rng.randrange(50), rng.choice([1, 1, -1])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, v long, __w long").repartition(5)
    how = user.Aggregator(dict, lambda s, v, w: {**s, v[0]: s.get(v[0], 0) + w}, lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}, lambda s: max(k for k, w in s.items() if w > 0), "long")
    want = {}
    for k, v, w in data:
        want.setdefault(k, {}).setdefault(v, 0)
        want[k][v] += w
    got = {r["k"]: r["top"] for r in user.aggregate_with(df, ["k"], ["v"], "top", how).collect()}
    assert got == {k: max(v for v, w in s.items() if w > 0) for k, s in want.items()}
    total = user.Aggregator(lambda: 0, lambda s, v, w: s + w, lambda a, b: a + b, lambda s: s, "long")
    assert [r["n"] for r in user.aggregate_with(df, [], ["v"], "n", total).collect()] == [sum(w for *_, w in data)]
    assert user.aggregate_with(df.limit(0), ["k"], ["v"], "top", how).count() == 0


def test_positions_and_vectors(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("m")).repartition(7)
    at = columnar.with_index(df, ["v"])
    assert at.where("index <> v").count() == 0 and at.count() == 1000
    assert sorted(r["index"] for r in columnar.filter_indices(df, ["v"], F.col("m") == 0).collect()) == sorted(r["v"] for r in df.where("m = 0").collect())
    assert rows(columnar.at_indices(df, ["v"], spark.createDataFrame([(3,), (999,), (5000,)], "index long")).select("v")) == [(3,), (999,)]
    assert rows(columnar.place_of(df, "v", 10)) == [(True, 10)] and rows(columnar.place_of(df.limit(0), "v", 10)) == [(False, 0)]
    one = spark.range(1).select(F.array(F.lit("c"), F.lit(None), F.lit("a")).alias("r"))
    pick = one.select(columnar.sorted_vector(F.col("r")), columnar.sorted_vector(F.col("r"), nulls_last=False), columnar.prefix(F.col("r"), 1), columnar.suffix(F.col("r"), 9), columnar.project(F.col("r"), 2, 0), columnar.concat(F.col("r"), F.col("r"))).first()
    assert list(map(list, pick)) == [["a", "c", None], [None, "a", "c"], ["c"], ["c", None, "a"], ["a", "c"], ["c", None, "a"] * 2]
    assert rows(columnar.dictionary_size(spark.createDataFrame([("a",), ("a",), (None,)], "v string"), "v")) == [(1,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.range(1).select(columnar.as_type(F.lit("x"), "bigint")).collect()

    def hash31(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    for s in ("", "a", "polygenelubricants", "Zwölf"):
        assert spark.range(1).select(columnar.hash31(F.lit(s))).first()[0] == hash31(s)


def test_partitions_hold_all_rows_and_are_even(spark):
    df = spark.range(1, 101).select(F.col("id").alias("i"))
    lots = columnar.split_batch(df, ["i"], 4)
    sizes = [lot.count() for lot in lots]
    assert sum(sizes) == 100 and min(sizes) > 10
    assert rows(lots[0].intersect(lots[1])) == []


def test_random_relations_and_expressions(spark):
    a, b, c = (testkit.relation(spark, 200, ["bigint", "double", "string", "boolean"], seed=s) for s in (1, 1, 2))
    assert rows(a) == rows(b) != rows(c) and a.dtypes == [("c0", "bigint"), ("c1", "double"), ("c2", "string"), ("c3", "boolean")]
    g = testkit.graph(spark, 10, 50)
    assert g.count() == 50 and g.where("src >= 10 OR dst >= 10 OR w < 1 OR w > 10").count() == 0
    assert testkit.expression(4) == testkit.expression(4) != testkit.expression(4, seed=1)
    with pytest.raises(ValueError, match="no random values"):
        testkit.relation(spark, 1, ["date"])


def in_turn(edges, sweeps=20):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {v: v for v in near}
    for _ in range(sweeps):
        moved = False
        for v in sorted(near):
            tally = {}
            for u in near[v]:
                tally[label[u]] = tally.get(label[u], 0) + 1
            best = min(tally, key=lambda x: (-tally[x], x))
            moved |= best != label[v]
            label[v] = best
        if not moved:
            break
    return label


@pytest.mark.parametrize("seed", range(3))
def test_label_propagation_in_turn_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(25)] if seed else [(a, b) for t in ((1, 2, 3), (4, 5, 6)) for a in t for b in t if a != b] + [(3, 4), (4, 3)]
    got = {r["id"]: r["label"] for r in graph.label_propagation_in_turn(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == in_turn(edges)


def test_sessions_merge_in_any_order():
    rng = random.Random(4)
    for _ in range(200):
        times, gap = [rng.randrange(100) for _ in range(rng.randrange(1, 20))], rng.randrange(1, 15)
        held = []
        for k in range(0, len(times), 3):
            held = merged(held, times[k : k + 3], gap)
        assert held == merged([], times, gap) and sum(n for *_, n in held) == len(times)
        assert all(b[0] - a[1] > gap for a, b in zip(held, held[1:], strict=False))
    assert merged([(100, 150, 2), (500, 500, 1)], [230, 320, 420], 100) == [(100, 500, 6)]


def test_state_of_a_log_checks_every_record(spark, tmp_path):
    log = storage.ChangeLog(spark, f"file://{tmp_path}/log")
    log.append([(1, "p", (1, "a"), 1)])
    spark.createDataFrame([(2, 0, "p", '["3","c"]', 1, 12345), (2, 1, "p", '["4","d"]', 1, None)], storage.SCHEMA).write.mode("append").parquet(log.path)
    with pytest.raises(Exception, match="fails its CRC"):
        log.state("p", "id long, n string").collect()
