"""Programs to DataFrames: one lazy plan for a rule, a driver loop for a recursive component.

A relation is a DataFrame with columns c0, c1, ..; derived relations are sets. Catalyst does what it can do: pushdown,
pruning, join strategy. Recursion is semi-naive; linear closures run by squaring, in logarithmically many rounds. Every
round ends in a scratch table, so plans stay short and nothing depends on one executor.
"""

from __future__ import annotations

import operator
import time
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans import rewrite
from weftline.plans.analysis import Component, TypeConflict, check_safety, group_variables, stratify, unify, value_type
from weftline.plans.ir import Aggregate, Arith, Atom, Compare, Const, Fact, Negated, Positive, Program, Rule, Sym, Term, Value, Var, variables
from weftline.plans.parser import parse
from weftline.session import counted, dealt, is_scratch, joined_parts, scratch, without

MAX_ROUNDS = 1000
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "variance": F.var_samp, "median": F.median}


def plain(value: Value) -> object:
    return value.name if isinstance(value, Sym) else value


def relation(spark: SparkSession, rows: Iterable[tuple], types: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T._parse_datatype_string("string" if t == "any" else t)) for i, t in enumerate(types)])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names c0, c1, ..."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def term_column(t: Term, at: dict[str, str], types: dict[str, str] | None = None) -> Column:
    """A term over the columns that hold its variables. Division by zero gives 0, whole numbers divide whole."""
    if isinstance(t, Var):
        return F.col(at[t.name])
    if isinstance(t, Const):
        v = plain(t.value)
        return F.lit(v).cast("bigint") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)
    if isinstance(t, Arith):
        a, b = term_column(t.left, at, types), term_column(t.right, at, types)
        if t.op == "+":
            return a + b
        if t.op == "-":
            return a - b
        if t.op == "*":
            return a * b
        zero = b == F.lit(0)
        if t.op == "mod":
            return F.when(zero, F.lit(0)).otherwise(a % F.when(zero, F.lit(None)).otherwise(b))
        if "double" in (kind(t.left, types), kind(t.right, types)):
            return F.when(zero, F.lit(0.0)).otherwise(a / F.when(zero, F.lit(None)).otherwise(b))
        return F.when(zero, F.lit(0).cast("bigint")).otherwise(_div(a, F.nullif(b, F.lit(0))))
    raise ValueError(f"{t} has no value here")


def _div(a: Column, b: Column) -> Column:
    return F.floor(F.abs(a.cast("decimal(38,0)")) / F.abs(b.cast("decimal(38,0)"))).cast("bigint") * F.when((a < 0) == (b < 0), 1).otherwise(-1)


def kind(t: Term, types: dict[str, str] | None) -> str:
    if isinstance(t, Var):
        return (types or {}).get(t.name, "any")
    if isinstance(t, Const):
        return value_type(t.value)
    if isinstance(t, Arith):
        return "double" if "double" in (kind(t.left, types), kind(t.right, types)) else "bigint"
    return "any"


def scan(rel: DataFrame, atom: Atom, slot: Callable[[str], str], keep: set[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The atom's rows with its variables as columns; constants and repeated variables are filters."""
    if len(rel.columns) != len(atom.args):
        raise ValueError(f"{atom} has {len(atom.args)} arguments, the relation {len(rel.columns)} columns")
    cond, first = None, {}
    for i, arg in enumerate(atom.args):
        c = F.col(f"c{i}")
        if isinstance(arg, Const):
            test = c.isNull() if arg.value is None else c == F.lit(plain(arg.value))
        elif isinstance(arg, Var) and arg.name in first:
            test = c.eqNullSafe(F.col(f"c{first[arg.name]}"))
        elif isinstance(arg, Var):
            first[arg.name] = i
            continue
        elif isinstance(arg, Arith):
            raise ValueError(f"{atom}: arithmetic stands in heads and comparisons only")
        else:
            continue
        cond = test if cond is None else cond & test
    if cond is not None:
        rel = rel.where(cond)
    names = [v for v in first if keep is None or v in keep]
    return rel.select(*[F.col(f"c{first[v]}").alias(slot(v)) for v in names]), names


class Context:
    """Relations by name while a program is evaluated."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables

    def get(self, pred: str, arity: int) -> DataFrame:
        found = self.tables.get(pred)
        if found is None:
            raise KeyError(f"no relation {pred}: it has neither facts nor rules, and no table of that name is registered")
        return found


def rule_frame(rule: Rule, ctx: Context, override: tuple[int, DataFrame] | None = None) -> DataFrame:
    """The head rows of a rule (not yet distinct). override puts another relation under one body literal, by index."""
    slots: dict[str, str] = {}

    def slot(v: str) -> str:
        return slots.setdefault(v, f"v{len(slots)}")

    used: dict[str, int] = {}
    for x in (rule.head, *rule.body):
        for v in set(variables(x)):
            used[v] = used.get(v, 0) + 1
    needed = {v for v, n in used.items() if n > 1}
    df: DataFrame | None = None
    bound: list[str] = []
    later = []

    def join(other: DataFrame, names: list[str]) -> None:
        nonlocal df, bound
        if df is None:
            df, bound = other, list(names)
            return
        shared = [v for v in names if v in bound]
        side = other.select(*[F.col(slot(v)).alias(f"r_{slot(v)}") if v in shared else F.col(slot(v)) for v in names])
        if shared:
            cond = None
            for v in shared:
                test = df[slot(v)].eqNullSafe(side[f"r_{slot(v)}"])
                cond = test if cond is None else cond & test
            df = df.join(side, cond).drop(*[f"r_{slot(v)}" for v in shared])
        else:
            df = df.crossJoin(side)
        bound += [v for v in names if v not in bound]

    def rel_of(i: int, atom: Atom) -> DataFrame:
        return override[1] if override is not None and override[0] == i else ctx.get(atom.pred, len(atom.args))

    for i, lit in enumerate(rule.body):
        if isinstance(lit, Positive):
            part, names = scan(rel_of(i, lit.atom), lit.atom, slot, needed)
            if not names:
                part = part.select(F.lit(1).alias("__any")).limit(1).drop("__any")
            join(part, names)
        elif isinstance(lit, Aggregate):
            part, _ = scan(rel_of(i, lit.atom), lit.atom, slot)
            groups = group_variables(rule, lit)
            out = AGGREGATES[lit.fn](F.col(slot(lit.target.name))).alias(slot(lit.result.name))
            join(part.groupBy(*[slot(v) for v in groups]).agg(out), [*groups, lit.result.name])
        else:
            later.append((i, lit))
    if df is None:
        df = ctx.spark.range(1).select()
    types = {v: dict(df.dtypes)[slot(v)] for v in bound}
    for i, lit in later:
        if isinstance(lit, Compare):
            a, b = term_column(lit.left, slots, types), term_column(lit.right, slots, types)
            df = df.where(_COMPARE[lit.op](a, b))
        elif isinstance(lit, Negated):
            part, names = scan(rel_of(i, lit.atom), lit.atom, slot)
            side = part.select(*[F.col(slot(v)).alias(f"n_{slot(v)}") for v in names]).distinct() if names else part.select(F.lit(1).alias("n__any")).limit(1)
            cond = F.lit(True)
            for v in names:
                cond = cond & df[slot(v)].eqNullSafe(side[f"n_{slot(v)}"])
            df = df.join(side, cond, "left_anti")
    return df.select(*[term_column(a, slots, types).alias(f"c{k}") for k, a in enumerate(rule.head.args)])


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union by place; whole and fractional columns meet in double, other disagreements in string."""
    kinds = []
    for i in range(len(parts[0].columns)):
        found = "any"
        if len({p.dtypes[i][1] for p in parts}) == 1 and parts[0].dtypes[i][1] != "void":
            kinds.append(parts[0].dtypes[i][1])
            continue
        for p in parts:
            have = p.dtypes[i][1]
            have = {"int": "bigint", "smallint": "bigint", "void": "any", "float": "double"}.get(have, have)
            try:
                found = unify(found, have)
            except TypeConflict:
                warnings.warn(f"column {i} mixes {found} and {have}; it becomes string", stacklevel=2)
                found = "string"
        kinds.append("string" if found == "any" else found)
    out = None
    for p in parts:
        p = p.select(*[F.col(c).cast(k).alias(f"c{i}") for i, (c, k) in enumerate(zip(p.columns, kinds, strict=True))])
        out = p if out is None else out.union(p)
    return out


def same(a: Column, b: Column, nulls: bool) -> Column:
    """Equality in which null equals null. Where there are none, plain equality does, by which tables in buckets are joined where they lie."""
    return a.eqNullSafe(b) if nulls else a == b


def anti(new: DataFrame, old: DataFrame, nulls: bool = True) -> DataFrame:
    """Rows of new that old lacks; null equals null."""
    side = old.toDF(*[f"o{i}" for i in range(len(old.columns))])
    cond = F.lit(True)
    for i in range(len(old.columns)):
        cond = cond & same(new[f"c{i}"], side[f"o{i}"], nulls)
    return new.join(side, cond, "left_anti")


def semi(new: DataFrame, old: DataFrame, nulls: bool = True) -> DataFrame:
    """Rows of new that old has too; null equals null."""
    side = old.toDF(*[f"o{i}" for i in range(len(old.columns))])
    cond = F.lit(True)
    for i in range(len(old.columns)):
        cond = cond & same(new[f"c{i}"], side[f"o{i}"], nulls)
    return new.join(side, cond, "left_semi")


def closure_edges(component: Component) -> tuple[Rule, Rule] | None:
    """The base rule and the step of a transitive closure p(X,Y) :- e(X,Y). p(X,Z) :- e(X,Y), p(Y,Z). (or p,e or p,p), else None."""
    if len(component.predicates) != 1 or len(component.rules) != 2:
        return None
    p = component.predicates[0]
    base = [r for r in component.rules if len(r.body) == 1 and isinstance(r.body[0], Positive) and r.body[0].atom.pred != p]
    step = [r for r in component.rules if len(r.body) == 2 and all(isinstance(x, Positive) for x in r.body)]
    if len(base) != 1 or len(step) != 1:
        return None
    b, s = base[0], step[0]
    if len(b.head.args) != 2 or b.head.args != b.body[0].atom.args or not all(isinstance(a, Var) for a in b.head.args) or b.head.args[0] == b.head.args[1]:
        return None
    allowed = {p, b.body[0].atom.pred}
    atoms = [x.atom for x in s.body]
    if {a.pred for a in atoms} - allowed or p not in {a.pred for a in atoms} or not all(isinstance(v, Var) for a in (*atoms, s.head) for v in a.args):
        return None
    for x, y in (atoms, atoms[::-1]):
        if len(x.args) == len(y.args) == 2 and x.args[1] == y.args[0] and s.head.args == (x.args[0], y.args[1]) and len({x.args[0], x.args[1], y.args[1]}) == 3:
            return b, s
    return None


@dataclass(frozen=True)
class Step:
    """What a round of a component did: rows that are new, by predicate (None where that is not counted), and its time."""

    stratum: int
    predicates: tuple[str, ...]
    round: int
    new: dict[str, int | None]
    seconds: float


Watch = Callable[[int, dict[str, int | None]], None]


def _unwatched(round_: int, new: dict[str, int | None]) -> None:
    pass


#: Pairs of a closure that a bucket is meant to hold, as a power of two.
BUCKET_BITS = 19


def bucket_count(spark: SparkSession, pairs: int) -> int:
    """Buckets for so many pairs: as many as a shuffle has partitions, fewer where they would hold little."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs >> BUCKET_BITS))


def has_nulls(df: DataFrame) -> bool:
    return not df.where(F.col("c0").isNull() | F.col("c1").isNull()).isEmpty()


def evaluate_closure(edges: DataFrame, max_rounds: int = MAX_ROUNDS, watch: Watch = _unwatched, name: str = "closure") -> DataFrame:
    """All pairs (c0, c1) joined by a path: paths double in length each round.

    After k rounds all pairs at most 2**k edges apart are known. A pair further apart, but not twice as far, has a midpoint exactly
    2**k edges from its start, so the pairs that far apart (their number of rounds is in __far) are joined with all: on a chain each
    pair is found once. Pairs lie in buckets of c0, where they are written once and joined in place; what a round shuffles is the
    pairs that it joins on the left, and those that it finds. Only where pairs outgrow their buckets are they dealt again, into more.
    """
    spark = edges.sparkSession
    edges, some = counted(edges, "closure-edges")
    n, nulls = bucket_count(spark, 4 * some), has_nulls(edges)
    new = dealt(edges.repartition(n, "c0").distinct().withColumn("__far", F.lit(0)), "c0", n, "closure", placed=True)
    total = new.count()
    watch(0, {name: total})
    parts, full = [new], new
    for k in range(max_rounds):
        far = new.where(F.col("__far") == k)
        if far.isEmpty():
            watch(k + 1, {name: 0})
            break
        a, b = far.select(F.col("c0").alias("x"), F.col("c1").alias("y")).repartition(n, "y"), full.toDF("u", "v", "far")
        steps = a.join(b, same(a.y, b.u, nulls)).select(F.col("x").alias("c0"), F.col("v").alias("c1"), F.when(F.col("far") == k, k + 1).otherwise(-1).alias("__far"))
        steps = steps.repartition(n, "c0").groupBy("c0", "c1").agg(F.max("__far").alias("__far"))
        new = dealt(anti(steps, full.drop("__far"), nulls), "c0", n, "closure-new", placed=True)
        some = new.count()
        watch(k + 1, {name: some})
        if not some:
            break
        parts.append(new)
        full, total = joined_parts(parts), total + some
        if (more := bucket_count(spark, total)) > 4 * n:
            n, full = more, dealt(full, "c0", more, "closure")
            parts = [full]
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    out = without(full, "__far")
    out._nulls = nulls
    return out


def evaluate_component(component: Component, ctx: Context, max_rounds: int = MAX_ROUNDS, watch: Watch = _unwatched) -> None:
    """Adds the component's relations to the context; watch hears of each round."""
    seeds: dict[str, list[DataFrame]] = {p: [ctx.tables[p]] if p in ctx.tables else [] for p in component.predicates}
    inside = set(component.predicates)
    if not component.recursive:
        for rule in component.rules:
            seeds[rule.head.pred].append(rule_frame(rule, ctx))
        for p, parts in seeds.items():
            ctx.tables[p] = _union(parts).distinct()
        watch(0, dict.fromkeys(component.predicates))
        return
    reads = {x.atom.pred for r in component.rules for x in r.body if not isinstance(x, Compare)} - inside
    kinds = column_types(component, seeds, ctx)
    for p in sorted(reads):  # every round reads them; they are worked out once
        if p in ctx.tables and not is_scratch(ctx.tables[p]):
            ctx.tables[p] = scratch(ctx.tables[p], f"input-{p}")
    if (found := closure_edges(component)) is not None:
        base, _ = found
        p = component.predicates[0]
        if not seeds[p]:
            ctx.tables[p] = evaluate_closure(rule_frame(base, ctx), max_rounds, watch, p)
            return
    exits = [r for r in component.rules if not any(isinstance(x, Positive) and x.atom.pred in inside for x in r.body)]
    loops = [r for r in component.rules if r not in exits]
    for rule in exits:
        seeds[rule.head.pred].append(rule_frame(rule, ctx))
    known = {p: parts for p, parts in seeds.items() if parts}
    if lost := inside - set(kinds):
        raise ValueError(f"{sorted(lost)}: no rule gives a first row")
    full, first = {}, {}
    for p in component.predicates:  # a predicate with recursive rules only starts empty
        like = [F.col(c).cast(k).alias(c) for c, k in kinds[p]]
        full[p], first[p] = counted(_union(known[p]).select(*like).distinct() if p in known else relation_like(ctx.spark, kinds[p]), f"full-{p}")
    watch(0, first)
    delta, parts = dict(full), {p: [df] for p, df in full.items()}
    for k in range(max_rounds):
        ctx.tables |= full
        steps: dict[str, list[DataFrame]] = {}
        for rule in loops:
            for i, lit in enumerate(rule.body):
                if isinstance(lit, Positive) and lit.atom.pred in inside:
                    steps.setdefault(rule.head.pred, []).append(rule_frame(rule, ctx, (i, delta[lit.atom.pred])))
        grown: dict[str, int] = {}
        for p in component.predicates:
            if p not in steps:
                delta[p] = full[p].limit(0)
                continue
            like = [F.col(c).cast(k).alias(c) for c, k in full[p].dtypes]
            new, some = counted(anti(_union(steps[p]).select(*like).distinct(), full[p]), f"new-{p}")
            delta[p], grown[p] = new, some
            if some:
                parts[p].append(new)
        watch(k + 1, grown)
        if not any(grown.values()):
            return
        full = {p: joined_parts(parts[p]) for p in inside}
    raise RuntimeError(f"no fixpoint of {', '.join(component.predicates)} in {max_rounds} rounds")


def column_types(component: Component, seeds: dict[str, list[DataFrame]], ctx: Context) -> dict[str, list[tuple[str, str]]]:
    """Names and types of the component's columns, from its seeds and all its rules, to a fixpoint; no job runs."""
    kinds = {p: _union(parts).dtypes for p, parts in seeds.items() if parts}
    changed = True
    while changed:
        changed = False
        for rule in component.rules:
            p = rule.head.pred
            if any(x.atom.pred in component.predicates and x.atom.pred not in kinds for x in rule.body if not isinstance(x, Compare)):
                continue
            probe = Context(ctx.spark, {**ctx.tables, **{q: relation_like(ctx.spark, k) for q, k in kinds.items()}})
            found = rule_frame(rule, probe)
            if p in kinds:
                found = _union([relation_like(ctx.spark, kinds[p]), found])
            if kinds.get(p) != found.dtypes:
                kinds[p], changed = found.dtypes, True
    return kinds


def _sizes(program: Program, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of the base relations for the order of joins: facts counted, tables guessed from the optimizer's statistics (no job runs)."""
    out: dict[str, int] = {}
    for f in program.facts:
        out[f.pred] = out.get(f.pred, 0) + 1
    for name, df in tables.items():
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        rows, size = stats.rowCount(), int(str(stats.sizeInBytes()))
        if rows.isDefined() or size < 1 << 60:  # beyond, the optimizer knows nothing
            out[name] = out.get(name, 0) + (int(str(rows.get())) if rows.isDefined() else size // (8 + 8 * max(1, len(df.columns))))
    return out


def relation_like(spark: SparkSession, dtypes: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"c{i} {k}" for i, (_, k) in enumerate(dtypes)))


class Engine:
    """A program over facts and registered tables.

    run() gives every derived relation, query() any relation or atom; insert() and retract() change facts. Facts are a
    Z-set unless set_mode: each insert adds its weight, and a row is there while its weight is above zero. With
    incremental, what is derived is kept up from each change; else it is derived again when it is next asked for.
    """

    def __init__(self, spark: SparkSession, program: Program | str, tables: dict[str, DataFrame] | None = None, *, set_mode: bool = False, optimize: bool = True, sizes: dict[str, int] | None = None, max_rounds: int = MAX_ROUNDS, incremental: bool = False) -> None:
        self.spark, self.set_mode, self.max_rounds, self.incremental = spark, set_mode, max_rounds, incremental
        self._kept = None
        self.source = parse(program) if isinstance(program, str) else program
        check_safety(self.source)
        self.program = rewrite.optimize(self.source, {**_sizes(self.source, tables or {}), **(sizes or {})}.get) if optimize else self.source
        self.components = stratify(self.program)
        self.inputs = {n: numbered(df) for n, df in (tables or {}).items()}
        self.weights: dict[str, dict[tuple, int]] = {}
        self.epoch = 0
        self.log: list[tuple[int, str, tuple, int]] = []
        for f in self.source.facts:
            self._add(f.pred, tuple(plain(v) for v in f.values), f.weight)
        self._done: dict[str, DataFrame] | None = None

    def _add(self, pred: str, row: tuple, weight: int) -> None:
        held = self.weights.setdefault(pred, {})
        now = held.get(row, 0)
        if self.set_mode:
            weight = (1 - now) if weight > 0 else -now
        held[row] = now + weight
        self.log.append((self.epoch, pred, row, weight))

    def insert(self, pred: str, row: Iterable[Value], weight: int = 1) -> None:
        self.epoch += 1
        values = tuple(plain(v) for v in row)
        was = self.weights.get(pred, {}).get(values, 0) > 0
        self._add(pred, values, weight)
        self._done = None
        if self._kept is not None and was != (self.weights[pred][values] > 0):
            like = self._kept.base.get(pred)
            if like is None:
                self._kept = None  # a relation that had no rows before: the program is started anew
                return
            types = [k for _, k in like.dtypes]
            own = relation(self.spark, [tuple(float(v) if k == "double" and v is not None else str(v) if k == "string" and v is not None else v for v, k in zip(values, types, strict=True))], types)
            self._kept.apply(pred, own.withColumn("__sign", F.lit(-1 if was else 1)), "__sign")

    def retract(self, pred: str, row: Iterable[Value], weight: int = 1) -> None:
        self.insert(pred, row, -weight)

    def facts(self) -> dict[str, DataFrame]:
        out = dict(self.inputs)
        for pred, held in self.weights.items():
            rows = [r for r, w in held.items() if w > 0]
            width = len(next(iter(held)))
            types = ["any"] * width
            for r in held:
                for i, v in enumerate(r):
                    try:
                        types[i] = unify(types[i], value_type(v))
                    except TypeConflict:
                        types[i] = "string"
            casts = [tuple(None if v is None else str(v) if t == "string" else float(v) if t == "double" else v for v, t in zip(r, types, strict=True)) for r in rows]
            own = relation(self.spark, casts, types)
            out[pred] = _union([out[pred], own]) if pred in out else own
        return out

    def run(self) -> dict[str, DataFrame]:
        """Derived relations by name, each a set."""
        if self._done is None and self.incremental:
            from weftline.streaming.incremental import Maintained

            if self._kept is None:
                self._kept = Maintained(self.spark, Program((), self.source.rules), self.facts(), self.max_rounds)
            self._done = dict(self._kept.state)
        if self._done is None:
            ctx = Context(self.spark, self.facts())
            for component in self.components:
                evaluate_component(component, ctx, self.max_rounds)
            self._done = ctx.tables
        return {p: self._done[p] for p in self.program.idb}

    def steps(self) -> Iterator[Step]:
        """Evaluates component by component and tells every round, for stepping through a program and for profiles."""
        ctx, self._done = Context(self.spark, self.facts()), None
        for component in self.components:
            told: list[Step] = []
            at = time.monotonic()

            def watch(k: int, new: dict[str, int | None], component: Component = component, told: list[Step] = told) -> None:
                nonlocal at
                told.append(Step(component.stratum, tuple(component.predicates), k, new, time.monotonic() - at))
                at = time.monotonic()

            evaluate_component(component, ctx, self.max_rounds, watch)
            yield from told
        self._done = ctx.tables

    def profile(self) -> str:
        """A report of all rounds: stratum, round, new rows and seconds."""
        lines = ["stratum  round  seconds  new rows"]
        for s in self.steps():
            lines.append(f"{s.stratum:>7}  {s.round:>5}  {s.seconds:>7.3f}  " + ", ".join(f"{p} {'lazy' if n is None else n}" for p, n in s.new.items()))
        return "\n".join(lines)

    def query(self, what: str | Atom, *, magic: bool = False) -> DataFrame:
        """A relation by name, or the rows that match an atom such as path(1, X): one column for each variable, or all if it has none.

        magic derives only what the atom's constants ask for.
        """
        if isinstance(what, str):
            text = what.strip().removeprefix("?-").removeprefix(":-").removeprefix("?").strip().rstrip(".").strip()
            if "(" not in text:
                self.run()
                return self._done[text].distinct()
            what = parse(f"?- {text}.").queries[0]
        if magic:
            program, atom = rewrite.magic_sets(self.source, what)
            inner = Engine(self.spark, Program((), program.rules), optimize=False, max_rounds=self.max_rounds)
            facts = self.facts()
            for f in program.facts[len(self.source.facts) :]:
                if f.pred.endswith("__facts"):
                    facts.setdefault(f.pred, self.facts()[f.pred.removesuffix("__facts")])
                else:
                    own = relation(self.spark, [tuple(plain(v) for v in f.values)], [value_type(v) for v in f.values])
                    facts[f.pred] = facts[f.pred].union(own) if f.pred in facts else own
            inner.inputs = facts
            inner.run()
            return match(inner._done[atom.pred], atom)
        self.run()
        return match(self._done[what.pred], what)

    def explain(self) -> str:
        """Strata and rules in evaluation order, as text."""
        out = []
        for c in self.components:
            out.append(f"stratum {c.stratum}: {', '.join(c.predicates)}" + (" (recursive)" if c.recursive else "") + (" by squaring" if closure_edges(c) else ""))
            out += [f"  {r}" for r in c.rules]
        return "\n".join(out)


def match(rel: DataFrame, atom: Atom) -> DataFrame:
    names = list(dict.fromkeys(variables(atom)))
    rows, found = scan(rel, atom, lambda v: f"v{names.index(v)}")
    if not found:
        return rel.where(_constants(atom)).distinct()
    return rows.distinct().toDF(*found)


def _constants(atom: Atom) -> Column:
    cond = F.lit(True)
    for i, a in enumerate(atom.args):
        if isinstance(a, Const):
            cond = cond & F.col(f"c{i}").eqNullSafe(F.lit(plain(a.value)))
    return cond


__all__ = ["Engine", "Fact", "Step", "evaluate_closure", "relation"]
