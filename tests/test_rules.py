from __future__ import annotations

import random

import pytest

from weftline.plans import rewrite, sql
from weftline.plans.analysis import TypeConflict, UnsafeRule, Unstratifiable, check_safety, infer_types, strata, stratify
from weftline.plans.engine import Engine
from weftline.plans.ir import Compare, Const, Positive, Sym
from weftline.plans.parser import ParseError, parse
from weftline.streaming.incremental import Maintained

TC = "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z)."


def rows(df):
    return sorted(map(tuple, df.collect()))


def closure(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in out if b == c}
        if more == out:
            return sorted(out)
        out = more


def test_parser_reads_every_kind_of_term():
    p = parse('f(1, -2.5, "a\\n\\"b\\"", :red, true). % note\n q(X + 1) :- r(X, _), not s(X), X >= 2 * 3. // more\n :- q(X).')
    assert p.facts[0].values == (1, -2.5, 'a\n"b"', Sym("red"), True)
    assert [type(x).__name__ for x in p.rules[0].body] == ["Positive", "Negated", "Compare"]
    assert p.queries[0].pred == "q"
    assert parse(str(p)) == p


@pytest.mark.parametrize("text", ["p(X", "p(X) :- .", "p(1) q(2).", "p(#)."])
def test_parser_refuses(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["p(X, Y) :- e(X).", "p(X) :- e(X), not f(Y).", "p(X) :- e(X), Y > 1.", "p(1). p(1, 2)."])
def test_unsafe_rules(text):
    with pytest.raises(UnsafeRule):
        check_safety(parse(text))


def test_strata():
    p = parse(TC + " v(X) :- edge(X, _). n(X, Y) :- v(X), v(Y), not path(X, Y).")
    assert strata(p) == [["path", "v"], ["n"]]
    with pytest.raises(Unstratifiable):
        stratify(parse("a(X) :- e(X), not b(X). b(X) :- e(X), not a(X)."))
    with pytest.raises(Unstratifiable):
        stratify(parse("a(C) :- e(X), C = count<Y>(a(Y))."))


def test_types():
    assert infer_types(parse("edge(1, 2). " + TC))["path"] == ["bigint", "bigint"]
    assert infer_types(parse("a(1). b(2.5). c(X) :- a(X). c(X) :- b(X)."))["c"] == ["double"]
    with pytest.raises(TypeConflict):
        infer_types(parse('depth("lake", 4.5). odd(D) :- depth(N, D), depth(D, _).'))


def test_rewrites():
    r = rewrite.simplify(parse("p(X) :- a(X, Y), b(Y, Z), a(X, Y), X > 2 + 3.").rules[0])
    assert [str(x) for x in r.body] == ["a(X, Y)", "X > 5", "b(Y, Z)"]
    r = rewrite.order_joins(parse("r(X) :- b(Y, Z), a(X, Y).").rules[0], {"a": 10, "b": 500}.get)
    assert r.body[0].atom.pred == "a"
    r = rewrite.order_joins(parse("r(X) :- a(X), c(Z), b(X, Z).").rules[0], {"a": 1, "c": 2, "b": 900}.get)
    assert [x.atom.pred for x in r.body if isinstance(x, Positive)] == ["a", "b", "c"]


RECURSIVE = [
    ("even(0). s(0, 1). s(1, 2). even(Y) :- odd(X), s(X, Y). odd(Y) :- even(X), s(X, Y).", "even", [(0,), (2,)]),
    ("p(0). e(0, 1). e(1, 2). e(2, 0). p(Y) :- p(X), e(X, Y).", "p", [(0,), (1,), (2,)]),
    ("n(0). m(3). p(X) :- n(X). p(X + 1) :- p(X), m(M), X < M, not n(9).", "p", [(0,), (1,), (2,), (3,)]),
    ("e(1, 1.5). p(X) :- e(X, _). p(Y) :- p(X), e(X, Y).", "p", [(1.0,), (1.5,)]),
    ("e(1, 2). e(2, 1). e(2, 2). p(X) :- e(X, X). p(X) :- e(X, Y), p(Y), X != Y.", "p", [(1,), (2,)]),
]


@pytest.mark.parametrize(("text", "pred", "want"), RECURSIVE)
def test_recursion(spark, text, pred, want):
    assert rows(Engine(spark, text).query(pred)) == want


def test_recursion_over_odd_values(spark):
    """Values compare and overflow in a recursive rule as they do in any other."""
    nan = float("nan")
    n = spark.createDataFrame([(nan,)], "x double")
    e = spark.createDataFrame([(nan, 2.0), (None, 3.0), (2.0, None)], "x double, y double")
    text = "n(X) :- t(X). n(Y) :- n(X), e(X, Y)."
    got = [r[0] for r in Engine(spark, text, {"t": n, "e": e}).query("n").collect()]
    assert sorted(map(str, got)) == ["2.0", "3.0", "None", "nan"]
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        Engine(spark, "p(9223372036854775806). p(X + 1) :- p(X), X > 0.").query("p").collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT"):
        Engine(spark, 'p("a"). p(X + 1) :- p(X).').query("p").collect()


@pytest.mark.parametrize(
    ("text", "pred", "want"),
    [
        ("e(1, 2). a(X) :- e(X, _). b(X) :- a(X).", "b", [(1,)]),
        ("e(1, 2). e(2, 3). p(X, Z) :- e(X, Y), e(Y, Z), Z = 3.", "p", [(1, 3)]),
        ('e(1, "a"). f("a", 2). f("a", 3). p(X) :- e(X, N), f(N, 3).', "p", [(1,)]),
        ("e(1, 1). e(1, 2). p(X) :- e(X, X).", "p", [(1,)]),
        ("q(4). p(X + 1, X / 0, X mod 3, -7 / 2) :- q(X).", "p", [(5, 0, 1, -3)]),
        ("e(1, 2). e(1, 3). e(2, 3). c(X, C) :- e(X, _), C = count<Y>(e(X, Y)).", "c", [(1, 2), (2, 1)]),
        ("e(1, 2). e(1, 4). c(S, M) :- S = sum<Y>(e(_, Y)), M = mean<Y>(e(_, Y)).", "c", [(6, 3.0)]),
        ("p(0). e(0, 1). e(1, 2). p(Y) :- p(X), e(X, Y).", "p", [(0,), (1,), (2,)]),
        ("even(0). s(0, 1). s(1, 2). even(Y) :- odd(X), s(X, Y). odd(Y) :- even(X), s(X, Y).", "even", [(0,), (2,)]),
        ("a(null). b(null). b(1). p(X) :- a(X), b(X).", "p", [(None,)]),
        ("e(1). f(2). p(X, Y) :- e(X), f(Y), X < Y.", "p", [(1, 2)]),
        ("e(1). p(X) :- e(X), not g(X, _). g(2, 2).", "p", [(1,)]),
    ],
)
def test_semantics(spark, text, pred, want):
    assert rows(Engine(spark, text).query(pred)) == want


def test_closure_with_insert_retract_and_magic(spark):
    e = Engine(spark, "edge(1, 2). edge(2, 3). edge(3, 1). edge(3, 4). " + TC)
    assert rows(e.query("path")) == closure([(1, 2), (2, 3), (3, 1), (3, 4)])
    assert rows(e.query("path(1, X)", magic=True)) == [(1,), (2,), (3,), (4,)]
    e.retract("edge", (3, 1))
    assert rows(e.query("path")) == closure([(1, 2), (2, 3), (3, 4)])
    e.insert("edge", (4, 5))
    assert len(rows(e.query("path"))) == 10
    assert rows(e.query("? path(1, 5).")) == [(1, 5)]


def test_incremental_engine_equals_scratch(spark):
    text = "edge(1, 2). edge(2, 3). edge(3, 1). " + TC + " apart(X, Y) :- v(X), v(Y), not path(X, Y). v(X) :- edge(X, _)."
    kept, fresh = Engine(spark, text, incremental=True), Engine(spark, text)
    kept.run()
    for change, row in (("insert", (3, 4)), ("retract", (3, 1)), ("insert", (2, 3)), ("retract", (2, 3))):
        for e in (kept, fresh):
            getattr(e, change)("edge", row)
        assert rows(kept.query("path")) == rows(fresh.query("path"))
    assert rows(kept.query("apart")) == rows(fresh.query("apart"))


def test_weights_and_set_mode(spark):
    bag, as_set = (Engine(spark, "f(1). g(X) :- f(X).", set_mode=m) for m in (False, True))
    for e in (bag, as_set):
        e.insert("f", (1,))
        e.retract("f", (1,))
    assert rows(bag.query("g")) == [(1,)]
    assert rows(as_set.query("g")) == []


def test_unknown_relation_says_so(spark):
    with pytest.raises(KeyError, match="no relation nope"):
        Engine(spark, "p(X) :- nope(X).").query("p")


def test_upkeep_equals_scratch(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(6), rng.randrange(6)) for _ in range(8)}
    m = Maintained(spark, TC, {"edge": spark.createDataFrame(sorted(edges), "a long, b long")})
    for step in (((5, 0), 1), (sorted(edges)[0], -1)):
        (a, b), w = step
        before = set(rows(m.state["path"]))
        changes = m.apply("edge", spark.createDataFrame([(a, b, w)], "a long, b long, w int"), "w")
        edges = edges | {(a, b)} if w > 0 else edges - {(a, b)}
        assert rows(m.state["path"]) == closure(edges)
        after = set(before)
        for x, y, s in changes["path"].collect():
            (after.add if s > 0 else after.remove)((x, y))
        assert sorted(after) == closure(edges)


def shuffled(spark, since: int = -1) -> tuple[int, int]:
    """The last stage, and the rows that stages after `since` have shuffled."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    told = [(found.apply(i).stageId(), found.apply(i).shuffleWriteRecords()) for i in range(found.size())]
    return max(k for k, _ in told), sum(n for k, n in told if k > since)


def test_upkeep_of_a_closure_shuffles_what_changes(spark):
    chains = [(100 * c + i, 100 * c + i + 1) for c in range(10) for i in range(60)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        m = Maintained(spark, TC, {"edge": spark.createDataFrame(chains, "a long, b long")})
        last, _ = shuffled(spark)
        m.apply("edge", spark.createDataFrame([(0, 1, -1), (99, 100, 1)], "a long, b long, w int"), "w")
        told = shuffled(spark, last)[1]
        pairs = {(100 * c + i, 100 * c + j) for c in range(10) for i in range(61) for j in range(i + 1, 61)}
        assert rows(m.state["path"]) == sorted(pairs - {(0, i) for i in range(61)} | {(99, 100 + i) for i in range(61)})
        assert told < len(pairs) == 18300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_closure_in_many_buckets(spark, monkeypatch):
    """Pairs that outgrow their buckets, nulls that come with a batch, rounds enough to join tables."""
    monkeypatch.setattr("weftline.plans.engine.BUCKET_BITS", 4)
    edges = {(i, i + 1) for i in range(12)} | {(20, 20), (21, 22), (22, 21)}
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    m = Maintained(spark, TC, {"edge": frame(sorted(edges))})
    assert rows(m.state["path"]) == closure(edges)
    go, come = {(10, 11), (21, 22)}, {(None, 0), (12, None), (5, 11)}
    m.apply("edge", spark.createDataFrame([(*e, -1) for e in go] + [(*e, 1) for e in come], "a long, b long, w int"), "w")
    named = lambda pairs: {tuple(-1 if v is None else v for v in pair) for pair in pairs}
    assert sorted(named(m.state["path"].collect())) == closure(named((edges - go) | come))


PROGRAMS = [
    (TC, ["path"]),
    ("odd(X, Y) :- edge(X, Y). even(X, Z) :- odd(X, Y), edge(Y, Z). odd(X, Z) :- even(X, Y), edge(Y, Z). two(X) :- even(X, X).", ["odd", "even", "two"]),
    ("edge(Y, X) :- mirror(X, Y), edge(X, Y). mirror(1, 2). mirror(3, 4). " + TC, ["path"]),
    ("out(X) :- edge(X, _). end(X) :- edge(_, X), not out(X).", ["end"]),
]


@pytest.mark.parametrize(("program", "preds"), PROGRAMS)
def test_upkeep_of_batches_equals_scratch(spark, program, preds):
    """Batches that insert and retract at once, through cycles, mutual recursion, and a relation with facts and rules."""
    rng = random.Random(5)
    edges = {(rng.randrange(5), rng.randrange(5)) for _ in range(9)}
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    m = Maintained(spark, program, {"edge": frame(sorted(edges))})
    told = {p: set(rows(m.state[p])) for p in preds}
    for _ in range(2 if program == TC else 1):
        go, come = set(rng.sample(sorted(edges), 3)), {(rng.randrange(6), rng.randrange(6)) for _ in range(2)}
        batch = [(*e, -1) for e in go] + [(*e, 1) for e in come]
        m.apply("edge", spark.createDataFrame(batch, "a long, b long, w int"), "w")
        edges = (edges - go) | come
        fresh = Engine(spark, program, {"edge": frame(sorted(edges))})
        assert {p: rows(m.state[p]) for p in preds} == {p: rows(fresh.query(p)) for p in preds}
    for p in preds:
        for *row, w, _ in sorted(m.outputs(p).collect(), key=lambda r: (r["__epoch"], r["__w"])):
            (told[p].add if w > 0 else told[p].remove)(tuple(row))
        assert sorted(told[p]) == rows(m.state[p])
    m.clear_outputs()
    assert m.outputs(preds[0]) is None and rows(m.state[preds[0]]) == sorted(told[preds[0]])


def test_steps_and_profile(spark):
    e = Engine(spark, "edge(1, 2). edge(2, 3). edge(3, 4). " + TC + " v(X) :- edge(X, _). n(0). n(X) :- n(Y), edge(Y, X). n(X) :- v(X).")
    told = list(e.steps())
    assert sum(s.new.get("path") or 0 for s in told) == 6 and [s.round for s in told if "path" in s.new] == [0, 1, 2, 3]
    assert any(s.new == {"v": None} for s in told) and all(s.seconds >= 0 for s in told)
    assert rows(e.query("path(1, X)")) == [(2,), (3,), (4,)]
    assert "path" in e.profile()


def test_sizes_of_relations_order_the_joins(spark):
    small, large = (spark.range(n).selectExpr("id AS a", "id AS b") for n in (3, 10**6))
    e = Engine(spark, "p(X) :- big(X, Y), few(Y, Z), big(Z, X).", {"big": large, "few": small})
    assert e.program.rules[0].body[0].atom.pred == "few"


def test_stream_of_changes(spark, tmp_path):
    spark.createDataFrame([(2, 3), (3, 4)], "a long, b long").write.parquet(str(tmp_path / "in"))
    m = Maintained(spark, "edge(1, 2). " + TC)
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    told = []
    q = m.attach(stream, "edge", checkpoint=str(tmp_path / "cp"), sink=lambda k, c: told.append(c["path"].count()))
    q.awaitTermination(120)
    assert rows(m.state["path"]) == closure([(1, 2), (2, 3), (3, 4)])
    assert sum(told) == 5


@pytest.fixture(scope="module")
def tables(spark):
    boats = spark.createDataFrame([(7, "Heron", 12.5), (8, "Teal", 9.0), (9, "Ibis", 12.5)], "hull long, title string, metres double")
    trips = spark.createDataFrame([(7, "north", 4), (7, "south", 11), (8, "north", 6), (9, None, 2)], "boat long, coast string, days long")
    return {"boats": boats, "trips": trips}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT b.title, t.days FROM trips t JOIN boats b ON t.boat = b.hull WHERE t.days >= 6", [("Heron", 11), ("Teal", 6)]),
        ("SELECT t.coast AS c, MAX(t.days) AS longest FROM trips AS t GROUP BY t.coast HAVING COUNT(*) > 1", [("north", 6)]),
        ("SELECT * FROM boats WHERE NOT metres > 10", [(8, "Teal", 9.0)]),
        ("SELECT hull FROM boats WHERE title = 'Ibis' OR metres < 10 -- small\n ORDER BY hull DESC LIMIT 1", [(9,)]),
        ("SELECT COUNT(DISTINCT boat) AS n, AVG(days) AS m FROM trips WHERE days * 2 > 6", [(2, 7.0)]),
    ],
)
def test_sql(spark, tables, text, want):
    assert rows(sql.run(spark, text, tables)) == want


def test_sql_to_rule_joins_on_a_shared_variable(spark, tables):
    schemas = {n: t.columns for n, t in tables.items()}
    rule = sql.translate("q", "SELECT b.title FROM boats b JOIN trips t ON b.hull = t.boat WHERE t.days > 6", schemas)
    assert sum(isinstance(x, Compare) for x in rule.body) == 1
    assert set(map(str, rule.body[0].atom.args)) & set(map(str, rule.body[1].atom.args))
    assert rows(Engine(spark, parse(str(rule)), tables).query("q")) == [("Heron",)]
    for bad in ("SELECT x FROM boats", "SELECT nope(hull) FROM boats", "SELECT hull FROM boats extra words here", "SELECT title FROM boats GROUP BY hull"):
        with pytest.raises(ParseError):
            sql.run(spark, bad, tables)
    assert Const(1) == Const(1)
