"""Weighted relations and their changes.

A delta is a DataFrame with the data columns, `__t` (array<bigint>, a logical time) and `__w` (a weight). Everything here
is a plain composition: consolidation is a hash aggregate with map-side combine, the incremental join is the union of
three joins on changes, the antijoin and the aggregate touch the changed keys only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import lattice
from weftline.functions.semiring import COUNTING, Semiring

T, W = "__t", "__w"


def lift(df: DataFrame, *, epoch: int = 0, weight: object = None, ring: Semiring = COUNTING) -> DataFrame:
    """Plain rows as a delta at one epoch."""
    w = ring.one_col() if weight is None else F.lit(weight).cast(ring.type)
    time = F.array(F.lit(epoch).cast("bigint")) if epoch else F.array().cast("array<bigint>")
    return df.withColumn(T, time).withColumn(W, w)


def ordered(df: DataFrame) -> DataFrame:
    """Rows by their data columns, then by time: the total order in which changes are shown."""
    return df.orderBy(*data(df), *([T] if T in df.columns else []))


def data(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (T, W)]


def consolidate(df: DataFrame, ring: Semiring = COUNTING, *, times: bool = True) -> DataFrame:
    """Equal rows (and times) become one with the summed weight; zeros go."""
    keys = [*data(df), *([T] if times and T in df.columns else [])]
    out = df.groupBy(*keys).agg(ring.plus_agg(F.col(W)).cast(ring.type).alias(W))
    return out.where(F.col(W) != ring.zero_col()).select(*[c for c in df.columns if c in (*keys, W)])


def merge(a: DataFrame, b: DataFrame, ring: Semiring = COUNTING) -> DataFrame:
    return consolidate(a.unionByName(b), ring)


def negate(df: DataFrame, ring: Semiring = COUNTING) -> DataFrame:
    if ring.negate is None:
        raise ValueError(f"{ring.name} has no negatives")
    return df.withColumn(W, ring.negate(F.col(W)))


def as_of(df: DataFrame, time: Sequence[int], ring: Semiring = COUNTING) -> DataFrame:
    """Rows and weights summed up to a time; no time column."""
    at = F.array(*[F.lit(x).cast("bigint") for x in time]) if time else F.array().cast("array<bigint>")
    return consolidate(df.where(lattice.before_or_at(F.col(T), at)).drop(T), ring)


def rows(df: DataFrame) -> DataFrame:
    """The set of rows with positive weight."""
    return consolidate(df.drop(T), COUNTING).where(F.col(W) > 0).drop(W)


def compact(df: DataFrame, frontier: Sequence[int], ring: Semiring = COUNTING) -> DataFrame:
    """Folds times at or before the frontier into the start; reads as of earlier times are undefined afterwards."""
    at = F.array(*[F.lit(x).cast("bigint") for x in frontier])
    return consolidate(df.withColumn(T, F.when(lattice.before_or_at(F.col(T), at), F.array().cast("array<bigint>")).otherwise(F.col(T))), ring)


def join(a: DataFrame, b: DataFrame, on: Sequence[str], ring: Semiring = COUNTING) -> DataFrame:
    """Rows of a and b that agree on the keys: a's columns, then b's others; weights multiply, times join. Null equals null."""
    rest = [c for c in data(b) if c not in on]
    clash = set(rest) & set(data(a))
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    side = b.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *rest, F.col(T).alias("__t2"), F.col(W).alias("__w2"))
    cond: Column = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & a[c].eqNullSafe(side[f"__k{i}"])
    out = a.join(side, cond) if on else a.crossJoin(side)
    return out.select(*data(a), *rest, lattice.join(F.col(T), F.col("__t2")).alias(T), ring.times_col(F.col(W), F.col("__w2")).alias(W))


def join_delta(a_before: DataFrame, a_change: DataFrame, b_before: DataFrame, b_change: DataFrame, on: Sequence[str], ring: Semiring = COUNTING) -> DataFrame:
    """What a join's result changes by: each change against the other's state before, and the changes against each other."""
    parts = [join(a_change, b_before, on, ring), join(a_before, b_change, on, ring), join(a_change, b_change, on, ring)]
    return consolidate(parts[0].unionByName(parts[1]).unionByName(parts[2]), ring)


def _same(a: DataFrame, side: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    side = side.toDF(*[f"__k{i}" for i in range(len(on))])
    cond: Column = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & a[c].eqNullSafe(side[f"__k{i}"])
    return a.join(side, cond, how)


def antijoin(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a whose key b does not hold with positive weight."""
    return _same(a, rows(b.select(*on, W)), on, "left_anti")


def antijoin_delta(a_before: DataFrame, a_change: DataFrame, b_before: DataFrame, b_change: DataFrame, on: Sequence[str]) -> DataFrame:
    """What an antijoin's result changes by. Only keys that b's change touches are looked at again; their rows are told off or in."""
    keys = b_change.select(*on).distinct()
    was = antijoin(_same(a_before, keys, on, "left_semi"), b_before, on)
    b_after = b_before.unionByName(b_change)
    now = antijoin(_same(a_before, keys, on, "left_semi"), b_after, on)
    return consolidate(negate(was).unionByName(now).unionByName(antijoin(a_change, b_after, on)).drop(T), COUNTING)


def weighted(fn: str, column: str | None = None) -> Column:
    """Aggregates of a weighted group by SQL's rules: nulls are left out. count, sum, min, max, mean, variance, median."""
    w = F.col(W)
    if fn == "count":
        return F.sum(w)
    v = F.col(column or "")
    n, s = F.sum(F.when(v.isNotNull(), w)), F.sum(v * w)
    if fn == "sum":
        return s
    if fn in ("min", "max"):
        return (F.min if fn == "min" else F.max)(F.when(w > 0, v))
    if fn == "mean":
        return s / n
    if fn == "variance":
        return F.when(n > 1, (F.sum(v * v * w) - s * s / n) / (n - 1))
    if fn == "median":
        return F.expr(f"percentile(`{column}`, 0.5, CASE WHEN {W} > 0 THEN {W} ELSE 0 END)")
    raise ValueError(f"unknown aggregate {fn}")


def aggregate(df: DataFrame, keys: Sequence[str], **how: tuple[str, str | None]) -> DataFrame:
    """One row for each group of positive total weight; how gives (function, column) for each result column."""
    flat = consolidate(df, COUNTING, times=False) if T in df.columns else df
    out = flat.groupBy(*keys).agg(F.sum(W).alias("__n"), *[weighted(f, c).alias(name) for name, (f, c) in how.items()])
    return out.where("__n > 0").drop("__n")


def aggregate_delta(before: DataFrame, change: DataFrame, keys: Sequence[str], **how: tuple[str, str | None]) -> DataFrame:
    """What an aggregate's result changes by: old rows of the touched groups with -1, new ones with +1."""
    touched = change.select(*keys).distinct()
    near = _same(before, touched, keys, "left_semi") if keys else before
    old = aggregate(near, keys, **how).withColumn(W, F.lit(-1).cast("bigint"))
    new = aggregate(near.unionByName(change), keys, **how).withColumn(W, F.lit(1).cast("bigint"))
    return consolidate(old.unionByName(new), COUNTING)
