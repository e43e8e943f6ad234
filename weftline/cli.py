"""Command line: run a program file, a prompt, SQL to rules, examples, timings."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import sql
from weftline.plans.analysis import strata
from weftline.plans.engine import Engine
from weftline.plans.ir import Compare, Negated, Program
from weftline.plans.parser import parse
from weftline.sources.storage import read_program


def session() -> SparkSession:
    spark = SparkSession.builder.appName("weftline").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(df: DataFrame, limit: int = 30) -> str:
    """Up to `limit` rows as a text table, sorted."""
    rows = sorted(df.limit(limit).collect(), key=str)
    cells = [df.columns, *[[str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = "+".join(["", *["-" * (w + 2) for w in width], ""])
    text = [line, *["|" + "|".join(f" {c:<{w}} " for c, w in zip(r, width, strict=True)) + "|" for r in cells], line]
    text.insert(2, line)
    return "\n".join(text)


def mermaid(program: Program) -> str:
    """The predicates and what they depend on."""
    out = ["graph LR"]
    for r in program.rules:
        for x in r.body:
            if not isinstance(x, Compare):
                out.append(f"  {x.atom.pred} {'-. not .->' if isinstance(x, Negated) else '-->'} {r.head.pred}")
    return "\n".join(dict.fromkeys(out))


def dot(program: Program) -> str:
    edges = [f'  "{x.atom.pred}" -> "{r.head.pred}"' + (" [style=dashed]" if isinstance(x, Negated) else "") + ";" for r in program.rules for x in r.body if not isinstance(x, Compare)]
    return "\n".join(["digraph rules {", *dict.fromkeys(edges), "}"])


HELP = """facts and rules are added as they are typed
? atom.        rows that match, e.g. ? path(1, X).
:load FILE     add a program file
:query NAME    a relation
:rules :facts :strata :mermaid :clear :help :quit
:egraph EXPR   simplify an expression"""


class Repl:
    def __init__(self, spark: SparkSession, say: Callable[[str], None] = print) -> None:
        self.spark, self.say, self.program, self.engine = spark, say, Program(), None

    def _add(self, text: str) -> None:
        more = parse(text)
        self.program = Program(self.program.facts + more.facts, self.program.rules + more.rules)
        self.engine = None
        for q in more.queries:
            self.say(table(self._engine().query(q)))

    def _engine(self) -> Engine:
        if self.engine is None:
            self.engine = Engine(self.spark, self.program)
        return self.engine

    def line(self, text: str) -> bool:
        """Handles a line; False ends the prompt."""
        text = text.strip()
        word, _, rest = text.partition(" ")
        try:
            if word in (":quit", ":q"):
                return False
            if not text:
                pass
            elif word == ":help":
                self.say(HELP)
            elif word == ":load":
                self._add(read_program(rest.strip()))
            elif word == ":query" or text.startswith("?"):
                self.say(table(self._engine().query(rest if word == ":query" else text)))
            elif word == ":rules":
                self.say("\n".join(map(str, self.program.rules)))
            elif word == ":facts":
                self.say("\n".join(map(str, self.program.facts)))
            elif word == ":strata":
                self.say("\n".join(f"{i}: {', '.join(s)}" for i, s in enumerate(strata(self.program))))
            elif word == ":mermaid":
                self.say(mermaid(self.program))
            elif word == ":egraph":
                from weftline import egraph

                self.say(str(egraph.simplify(egraph.parse(rest))))
            elif word == ":clear":
                self.program, self.engine = Program(), None
            elif word.startswith(":") and not text.startswith(":-"):
                self.say(f"unknown command {word}; :help lists them")
            else:
                self._add(text)
        except (ValueError, KeyError, TypeError, OSError) as e:
            self.say(f"error: {e}")
        return True


def examples(spark: SparkSession, say: Callable[[str], None] = print) -> None:
    from weftline import egraph
    from weftline.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    say("page rank\n" + table(graph.page_rank(edges)))
    points = Engine(spark, 'alloc("a", "O1"). assign("b", "a"). points(V, O) :- alloc(V, O). points(V, O) :- assign(V, W), points(W, O).')
    say("points-to\n" + table(points.query("points")))
    tx = spark.createDataFrame([("tx1", "A", "B"), ("tx2", "B", "C"), ("tx3", "C", "D")], "id string, src string, dst string")
    say("taint\n" + table(graph.taint(tx, "A")))
    say("strength reduction\n" + str(egraph.reduce_strength(egraph.parse("(x * 2) + 0"))))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run", help="evaluate a program file")
    run.add_argument("file")
    run.add_argument("--explain", action="store_true")
    sub.add_parser("repl", help="a prompt")
    sub.add_parser("examples", help="small worked examples")
    sub.add_parser("bench", help="time the headline programs")
    lower = sub.add_parser("sql", help="a SELECT as a rule")
    lower.add_argument("query")
    lower.add_argument("--schemas", default="{}", help='JSON such as {"users": ["id", "name"]}')
    args = top.parse_args(argv)
    if args.what == "sql":
        print(sql.translate("result", args.query, json.loads(args.schemas)))
        return 0
    spark = session()
    if args.what == "run":
        engine = Engine(spark, read_program(args.file))
        if args.explain:
            print(engine.explain())
        for name, df in sorted(engine.run().items()):
            print(f"{name}\n{table(df)}")
        for q in engine.source.queries:
            print(f"? {q}\n{table(engine.query(q))}")
    elif args.what == "examples":
        examples(spark)
    elif args.what == "bench":
        from weftline.plans.engine import evaluate_closure

        began = time.time()
        n = evaluate_closure(spark.range(199).selectExpr("id AS c0", "id + 1 AS c1")).count()
        print(f"closure of a chain of 200: {n} pairs, {time.time() - began:.2f} s")
    else:
        repl = Repl(spark)
        for line in sys.stdin:
            if not repl.line(line):
                break
    return 0


if __name__ == "__main__":
    sys.exit(main())
