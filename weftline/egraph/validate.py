"""Whether two expressions agree: a proof by saturation, or a counterexample from a grid that Spark searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftline.egraph import ARITHMETIC, Expr, Proof, Rewrite, prove

#: Values tried for every variable.
GRID = (-17, -3, -1, 0, 1, 2, 4, 9, 40)


def column(e: Expr) -> Column:
    """An expression over bigint columns named as its variables."""
    if e.op == "var":
        return F.col(str(e.value))
    if e.op == "const":
        return F.lit(e.value) if isinstance(e.value, bool) else F.lit(e.value).cast("bigint")
    a = [column(x) for x in e.args]
    if e.op == "neg":
        return -a[0]
    if e.op == "not":
        return ~a[0]
    if e.op == "shl":
        return (a[0] * F.pow(F.lit(2.0), a[1])).cast("bigint")
    if e.op in ("/", "%"):
        safe = F.nullif(a[1], F.lit(0).cast("bigint"))
        whole = (F.floor(F.abs(a[0]) / F.abs(safe)) * F.when((a[0] < 0) == (a[1] < 0), 1).otherwise(-1)).cast("bigint")
        return F.when(a[1] == 0, F.lit(0).cast("bigint")).otherwise(whole if e.op == "/" else a[0] % safe)
    table = {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "and": lambda: a[0] & a[1], "or": lambda: a[0] | a[1]}
    if e.op not in table:
        raise ValueError(f"operator {e.op} has no value")
    return table[e.op]()


def counterexample(spark: SparkSession, left: Expr, right: Expr, grid: tuple[int, ...] = GRID) -> dict[str, int] | None:
    """Values on the grid for which the sides differ. None is no proof: only the grid was searched."""
    names = sorted(left.names() | right.names())
    values = ", ".join(f"({v})" for v in grid)
    df = spark.range(1).select()
    for n in names:
        df = df.crossJoin(spark.sql(f"SELECT CAST(v AS BIGINT) AS `{n}` FROM VALUES {values} AS t(v)"))
    found = df.where(~column(left).eqNullSafe(column(right))).limit(1).collect()
    return found[0].asDict() if found else None


@dataclass(frozen=True)
class Verdict:
    equal: bool | None
    proof: Proof | None = None
    counterexample: dict[str, int] | None = None


def validate(spark: SparkSession, left: Expr, right: Expr, rules: list[Rewrite] = ARITHMETIC) -> Verdict:
    """equal is True with a proof, False with a counterexample, None if neither was found."""
    proof = prove(left, right, rules)
    if proof is not None:
        return Verdict(True, proof)
    found = counterexample(spark, left, right)
    return Verdict(None) if found is None else Verdict(False, None, found)
