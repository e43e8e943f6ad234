"""Programs kept up to date: each batch of changes is an epoch, and the derived rows that come or go are told.

In programs of positive rules a batch is worked out from the change alone. Retracted rows take with them all that was
derived through them, round by round; of that, what other derivations still give comes back. Inserted rows are joined
against the state, rule by rule. Where negation or aggregates stand in what a change reaches, those components are
derived again. States are scratch tables, so epochs do not pile up in one plan. `attach` runs an epoch for each
micro-batch of a stream. The changes of all epochs are kept as an output log until `clear_outputs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.analysis import Component
from weftline.plans.engine import MAX_ROUNDS, Context, Engine, _union, anti, closure_edges, evaluate_component, has_nulls, numbered, rule_frame, same, semi
from weftline.plans.ir import Compare, Positive, Program
from weftline.session import buckets_of, counted, dealt, drop_scratch, is_scratch, joined_parts, scratch


def _net(came: DataFrame, went: DataFrame | None, nulls: bool = True) -> DataFrame:
    """Changes of both directions in one table; a row that went and came again has none."""
    if went is None:
        return came
    return anti_rows(came, went, nulls).union(anti_rows(went.withColumn("__w", F.lit(-1)), came, nulls))


def anti_rows(a: DataFrame, b: DataFrame, nulls: bool = True) -> DataFrame:
    """Rows of a whose data columns b lacks."""
    names = [c for c in a.columns if c != "__w"]
    side = b.select(*[F.col(c).alias(f"o_{c}") for c in names])
    cond = F.lit(True)
    for c in names:
        cond = cond & same(a[c], side[f"o_{c}"], nulls)
    return a.join(side, cond, "left_anti")


#: Tables of a round that are read as one before they are written as one.
FEW_PARTS = 8


def _few(parts: list[DataFrame]) -> list[DataFrame]:
    """The same tables in buckets, as one where they have become many: the small ones of the rounds, not the state."""
    if len(parts) < FEW_PARTS:
        return parts
    return [dealt(joined_parts(parts), *buckets_of(parts[0]), "joined", placed=True)]


class Maintained:
    """A program's relations and their upkeep. State is a set of rows for each base relation (an insert of a row that is there does nothing)."""

    def __init__(self, spark: SparkSession, program: Program | str, tables: dict[str, DataFrame] | None = None, max_rounds: int = MAX_ROUNDS) -> None:
        self.spark, self.max_rounds, self.epoch = spark, max_rounds, 0
        engine = Engine(spark, program, tables)
        self.components = engine.components
        self.base = {n: scratch(df.distinct(), f"base-{n}") for n, df in engine.facts().items()}
        ctx = Context(spark, dict(self.base))
        for c in self.components:
            evaluate_component(c, ctx, max_rounds)
        self.state = {n: df if is_scratch(df) else scratch(df, f"state-{n}") for n, df in ctx.tables.items()}
        self.closures = {c.predicates[0]: found[0].body[0].atom.pred for c in self.components if (found := closure_edges(c)) and buckets_of(self.state[c.predicates[0]])}
        self.nulls = {p: self.state[p]._nulls for p in self.closures}
        self._ends: dict[str, DataFrame] = {}
        self.log: dict[str, list[tuple[int, DataFrame]]] = {}

    def outputs(self, pred: str) -> DataFrame | None:
        """All changes of a derived relation so far: its columns, __w (+1 or -1) and __epoch; None before its first epoch."""
        out = None
        for epoch, df in self.log.get(pred, []):
            told = df.withColumn("__epoch", F.lit(epoch))
            out = told if out is None else out.union(told)
        return out

    def clear_outputs(self) -> None:
        """Forgets the changes told so far; the state stays."""
        drop_scratch(self.spark, *[df for told in self.log.values() for _, df in told])
        self.log = {}

    def _reached(self, changed: set[str]) -> list[Component]:
        out, dirty = [], set(changed)
        for c in self.components:
            if any(x.atom.pred in dirty for r in c.rules for x in r.body if not isinstance(x, Compare)) or dirty & set(c.predicates):
                out.append(c)
                dirty |= set(c.predicates)
        return out

    def apply(self, pred: str, rows: DataFrame, weight: str | None = None) -> dict[str, DataFrame]:
        """One epoch: rows of a base relation come (or go, where the column `weight` is negative). Returns for each derived relation its changes, with __w +1 or -1."""
        self.epoch += 1
        self._ends = {}
        if pred in self.closures:  # rows of its own: it is no closure of edges any more
            del self.closures[pred]
        changes = self._changed(pred, rows, weight)
        for p, df in changes.items():
            changes[p], some = counted(df, f"changes-{p}", placed=p in self.closures)
            if some:
                self.log.setdefault(p, []).append((self.epoch, changes[p]))
        return changes

    def _changed(self, pred: str, rows: DataFrame, weight: str | None) -> dict[str, DataFrame]:
        like = self.base.get(pred)
        plus = rows if weight is None else rows.where(F.col(weight) > 0).drop(weight)
        minus = rows.limit(0) if weight is None else rows.where(F.col(weight) < 0).drop(weight)
        plus, minus = numbered(plus).distinct(), numbered(minus).distinct()
        if like is not None:
            cast = [F.col(c).cast(k).alias(c) for c, k in like.dtypes]
            plus, minus = plus.select(*cast), minus.select(*cast)
            minus = anti(semi(minus, like), plus)
            plus = anti(plus, like)
        plus, some_come = counted(plus, f"plus-{pred}")
        minus, some_go = counted(minus if like is not None else minus.limit(0), f"minus-{pred}")
        kept = like if like is None or not some_go else scratch(anti(like, minus), f"base-{pred}")
        reached = self._reached({pred})
        positive = all(isinstance(x, (Positive, Compare)) for c in reached for r in c.rules for x in r.body)
        before = dict(self.state)
        if positive and like is not None:
            went = self._shrink(pred, minus, kept, reached) if some_go else {}
            self.base[pred] = joined_parts([kept, plus]) if some_come else kept
            came = self._grow(pred, plus, reached) if some_come else {}
            if not some_come:
                self.state[pred] = self.state[pred] if any(pred in c.predicates for c in reached) else kept
                return {p: df.withColumn("__w", F.lit(-1)) for p, df in went.items()}
            return {p: _net(came[p], went.get(p), p not in self.closures or self.nulls[p]) for p in came}
        self.base[pred] = plus if kept is None else joined_parts([kept, plus])
        ctx = Context(self.spark, {**self.state, pred: self.base[pred]})
        changes = {}
        for c in reached:
            for p in c.predicates:
                if p in self.base:
                    ctx.tables[p] = self.base[p]
                else:
                    ctx.tables.pop(p, None)
            evaluate_component(c, ctx, self.max_rounds)
            for p in c.predicates:
                if not is_scratch(ctx.tables[p]):
                    ctx.tables[p] = scratch(ctx.tables[p], f"state-{p}")
                if p in self.closures:
                    self.nulls[p] = ctx.tables[p]._nulls
        self.state = ctx.tables
        for c in reached:
            for p in c.predicates:
                was, now = before.get(p), self.state[p]
                came = now if was is None else anti(now, was)
                went = now.limit(0) if was is None else anti(was, now)
                changes[p] = came.withColumn("__w", F.lit(1)).union(went.withColumn("__w", F.lit(-1)))
        return changes

    def _shrink(self, pred: str, minus: DataFrame, kept: DataFrame, reached: list[Component]) -> dict[str, DataFrame]:
        """Takes rows of a base relation out of the state; returns what went from each derived relation."""
        self.base[pred] = kept
        old, now, gone = dict(self.state), {**self.state, pred: kept}, {pred: minus}
        old[pred] = kept.union(minus) if pred not in {p for c in reached for p in c.predicates} else self.state[pred]
        out = {}
        for c in reached:
            if (p := c.predicates[0]) in self.closures:
                if (edges := self.closures[p]) in gone:
                    out[p], some = self._shrink_closure(p, gone[edges], old[p], now)
                    if some:
                        gone[p] = out[p]
                continue
            over: dict[str, list[DataFrame]] = {p: [minus] if p == pred else [] for p in c.predicates}
            first = dict(gone)
            for _ in range(self.max_rounds):
                steps = self._steps(c, old, first)
                first = {}
                for p, parts in steps.items():
                    like = [F.col(n).cast(k).alias(n) for n, k in old[p].dtypes]
                    new = semi(_union(parts).select(*like).distinct(), old[p])
                    new, some = counted(anti(new, joined_parts(over[p])) if over[p] else new, f"over-{p}")
                    if some:
                        first[p] = new
                        over[p].append(new)
                if not first:
                    break
            lost = {p: joined_parts(parts) for p, parts in over.items() if parts}
            for p, df in lost.items():
                rest = anti(old[p], df)
                now[p] = scratch(rest.union(semi(self.base[p], df)) if p in self.base else rest, f"state-{p}")
            back = None
            for _ in range(self.max_rounds):  # what other derivations give comes back
                steps = self._steps(c, now, back)
                back = {}
                for p, parts in steps.items():
                    if p not in lost:
                        continue
                    like = [F.col(n).cast(k).alias(n) for n, k in now[p].dtypes]
                    new, some = counted(anti(semi(_union(parts).select(*like).distinct(), lost[p]), now[p]), f"back-{p}")
                    if some:
                        back[p] = new
                for p, df in back.items():
                    now[p] = joined_parts([now[p], df])
                if not back:
                    break
            for p, df in lost.items():
                out[p], some = counted(anti(df, now[p]), f"gone-{p}")
                if some:
                    gone[p] = out[p]
                else:
                    gone.pop(p, None)
        self.state = now
        return out

    def _edges_by_end(self, p: str, tables: dict[str, DataFrame]) -> DataFrame:
        """The edges of a closure in buckets of their ends, so that the rounds of an epoch join changed pairs with them in place."""
        edges = self.closures[p]
        return self._ends[edges] if edges in self._ends else dealt(tables[edges], "c1", buckets_of(self.state[p])[1], f"ends-{edges}")

    def _before(self, pairs: DataFrame, ends: DataFrame, nulls: bool) -> DataFrame:
        """Pairs made longer by an edge before them; with repetitions, dealt by their start."""
        e = ends.toDF("x", "y")
        return e.join(pairs, same(e.y, pairs.c0, nulls)).select(F.col("x").alias("c0"), "c1").repartition(buckets_of(ends)[1], "c0")

    def _through(self, edges: DataFrame, pairs: DataFrame, nulls: bool) -> DataFrame:
        """The edges, and the pairs that begin with one of them; dealt by their start."""
        n = buckets_of(pairs)[1]
        e, b = edges.toDF("x", "y").repartition(n, "y"), pairs.toDF("u", "v")
        return edges.union(e.join(b, same(e.y, b.u, nulls)).select(F.col("x").alias("c0"), F.col("v").alias("c1"))).repartition(n, "c0").distinct()

    def _shrink_closure(self, p: str, minus: DataFrame, was: DataFrame, now: dict[str, DataFrame]) -> tuple[DataFrame, int]:
        """`_shrink` for a transitive closure: what a round shuffles grows with the pairs that go, not with those that are.

        A pair that rests on lost edges runs over kept ones to the first of them, and from there as some pair did.
        """
        n, nulls, edges = buckets_of(was)[1], self.nulls[p], now[self.closures[p]]
        ends = self._ends[self.closures[p]] = self._edges_by_end(p, now)
        first = dealt(self._through(minus, was, nulls), "c0", n, f"over-{p}", placed=True)
        over = [first]
        for _ in range(self.max_rounds):
            new = anti(self._before(first, ends, nulls).distinct(), joined_parts(over), nulls)
            first = dealt(new, "c0", n, f"over-{p}", placed=True)
            if first.isEmpty():
                break
            over = _few([*over, first])
        else:
            raise RuntimeError(f"no fixpoint of {p} in {self.max_rounds} rounds")
        lost = joined_parts(over)
        rest = dealt(anti(was, lost, nulls), "c0", n, f"state-{p}", placed=True)
        # what other derivations give comes back: kept edges themselves, and kept edges before pairs that stay
        e = edges.toDF("x", "y").repartition(n, "x")
        ways = lost.join(e, same(lost.c0, e.x, nulls)).select("c0", F.col("y").alias("mid"), "c1")
        b = rest.toDF("u", "v")
        longer = ways.repartition(n, "mid")
        longer = longer.join(b, same(longer.mid, b.u, nulls) & same(longer.c1, b.v, nulls), "left_semi")
        first = dealt(ways.where(F.col("mid").eqNullSafe(F.col("c1"))).union(longer).select("c0", "c1").repartition(n, "c0").distinct(), "c0", n, f"back-{p}", placed=True)
        back: list[DataFrame] = []
        for _ in range(self.max_rounds):
            if first.isEmpty():
                break
            back = _few([*back, first])
            new = anti(semi(self._before(first, ends, nulls).distinct(), lost, nulls), joined_parts(back), nulls)
            first = dealt(new, "c0", n, f"back-{p}", placed=True)
        now[p] = joined_parts([rest, *back])
        if back:
            lost = dealt(anti(lost, joined_parts(back), nulls), "c0", n, f"gone-{p}", placed=True)
        return lost, lost.count()

    def _grow_closure(self, p: str, plus: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        """`_grow` for a transitive closure; returns the new pairs. Each runs over any edges to its last new one, and from there as some pair did."""
        was, edges = tables[p], self.closures[p]
        n = buckets_of(was)[1]
        self.nulls[p] = nulls = self.nulls[p] or has_nulls(plus)
        ends = joined_parts([self._ends[edges], dealt(plus, "c1", n, f"ends-{edges}")]) if edges in self._ends else self._edges_by_end(p, tables)
        first = dealt(anti(self._through(plus, was, nulls), was, nulls), "c0", n, f"new-{p}", placed=True)
        found = [first]
        for _ in range(self.max_rounds):
            new = anti(anti(self._before(first, ends, nulls).distinct(), was, nulls), joined_parts(found), nulls)
            first = dealt(new, "c0", n, f"new-{p}", placed=True)
            if first.isEmpty():
                break
            found = _few([*found, first])
        else:
            raise RuntimeError(f"no fixpoint of {p} in {self.max_rounds} rounds")
        tables[p] = joined_parts([was, *found])
        return joined_parts(found)

    def _steps(self, c: Component, tables: dict[str, DataFrame], first: dict[str, DataFrame] | None) -> dict[str, list[DataFrame]]:
        """Head rows of the component's rules by predicate: with a row of `first` in one literal, or all."""
        ctx, steps = Context(self.spark, dict(tables)), {}
        for r in c.rules:
            if first is None:
                steps.setdefault(r.head.pred, []).append(rule_frame(r, ctx))
                continue
            for i, x in enumerate(r.body):
                if isinstance(x, Positive) and x.atom.pred in first:
                    steps.setdefault(r.head.pred, []).append(rule_frame(r, ctx, (i, first[x.atom.pred])))
        return steps

    def _grow(self, pred: str, plus: DataFrame, reached: list[Component]) -> dict[str, DataFrame]:
        deltas = {pred: plus}
        derived = any(pred in c.predicates for c in reached)
        if derived:
            plus = scratch(anti(plus, self.state[pred]), f"plus-{pred}")
        tables = {**self.state, pred: joined_parts([self.state[pred], plus]) if derived else self.base[pred]}
        changes = {}
        for c in reached:
            if (p := c.predicates[0]) in self.closures:
                if (edges := self.closures[p]) in deltas:
                    deltas[p] = self._grow_closure(p, deltas[edges], tables)
                    changes[p] = deltas[p].withColumn("__w", F.lit(1))
                else:
                    changes[p] = tables[p].limit(0).withColumn("__w", F.lit(1))
                continue
            new_all: dict[str, list[DataFrame]] = {p: [] for p in c.predicates}
            if pred in c.predicates:
                new_all[pred].append(plus)
            first = {p: d for p, d in deltas.items()}
            for _ in range(self.max_rounds):
                steps = self._steps(c, tables, first)
                first = {}
                for p, parts in steps.items():
                    cast = [F.col(n).cast(k).alias(n) for n, k in tables[p].dtypes]
                    new, some = counted(anti(_union(parts).select(*cast).distinct(), tables[p]), f"new-{p}")
                    if some:
                        first[p] = new
                        new_all[p].append(new)
                for p, new in first.items():
                    tables[p] = joined_parts([tables[p], new])
                if not first:
                    break
                if not c.recursive:
                    break
            for p, parts in new_all.items():
                total = tables[p].limit(0)
                for part in parts:
                    total = total.union(part)
                if parts:
                    deltas[p] = total
                changes[p] = total.withColumn("__w", F.lit(1))
        self.state = tables
        return changes

    def attach(self, stream: DataFrame, pred: str, *, weight: str | None = None, checkpoint: str | None = None, sink: Callable[[int, dict[str, DataFrame]], None] | None = None, trigger: dict | None = None):
        """Starts a streaming query that applies every micro-batch as an epoch; sink gets (batch id, changes)."""

        def each(batch: DataFrame, batch_id: int) -> None:
            changes = self.apply(pred, batch, weight)
            if sink is not None:
                sink(batch_id, changes)

        writer = stream.writeStream.foreachBatch(each).trigger(**(trigger or {"availableNow": True}))
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
