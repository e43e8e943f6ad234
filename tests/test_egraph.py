from __future__ import annotations

from weftline import cli
from weftline.egraph import ARITHMETIC, BOOLEAN, EGraph, UnionFind, evaluate, parse, prove, reduce_strength, saturate, simplify, var
from weftline.egraph.validate import counterexample, validate


def test_union_find_and_congruence():
    u = UnionFind()
    a, b, c = u.make(), u.make(), u.make()
    u.union(a, b)
    assert u.find(a) == u.find(b) != u.find(c)
    g = EGraph()
    x, y = g.add(parse("f(a)")), g.add(parse("f(b)"))
    g.merge(g.lookup(var("a")), g.lookup(var("b")))
    g.rebuild()
    assert g.find(x) == g.find(y)


def test_matching():
    g = EGraph()
    g.add(parse("(a + b) * c"))
    assert len(list(g.matches(parse("(?x + ?y) * ?z")))) == 1
    assert len(list(g.matches(parse("?x + ?x")))) == 0


def test_saturation():
    assert str(simplify(parse("(x + 0) + 0"))) == "x"
    assert str(simplify(parse("((x * 1) + 0) * (2 - 2)"), iterations=8, nodes=2000)) == "0"
    assert str(simplify(parse("not(not(x))"), BOOLEAN)) == "x" and str(simplify(parse("and(x, true)"), BOOLEAN)) == "x"
    assert "shl" in str(reduce_strength(parse("(x * 2) + 0")))
    g = EGraph()
    g.add(parse("x + 0"))
    assert saturate(g, ARITHMETIC).saturated
    assert evaluate(parse("-7 / 2 + 5 % 3 + (1 << 3)"), {}) == 7


def test_validation(spark):
    assert validate(spark, parse("(x + 0) * 1"), parse("x")).equal is True
    found = validate(spark, parse("x + 1"), parse("x + 2"))
    assert found.equal is False and "x" in found.counterexample
    assert counterexample(spark, parse("x / 0"), parse("0")) is None
    assert prove(parse("x + 0"), parse("x")).markdown().startswith("# Proof")


def test_prompt(spark, tmp_path):
    said: list[str] = []
    repl = cli.Repl(spark, said.append)
    (tmp_path / "p.dl").write_text("edge(2, 3).")
    for line in ("edge(1, 2).", f":load {tmp_path}/p.dl", "path(X, Y) :- edge(X, Y).", "path(X, Z) :- edge(X, Y), path(Y, Z).", "? path(1, X).", ":strata", ":mermaid", ":egraph x * 1", "bad(", ":nope", ":rules", ":facts", ":help"):
        assert repl.line(line)
    text = "\n".join(said)
    assert "| 3 |" in text and "edge --> path" in text and "error:" in text and "unknown command" in text and not repl.line(":quit")
