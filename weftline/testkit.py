"""Random relations, graphs and expressions for tests and benchmarks; the same seed gives the same ones."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
KINDS = ("bigint", "double", "string", "boolean")


def relation(spark: SparkSession, n: int, kinds: Sequence[str], *, values: int = 100, seed: int = SEED) -> DataFrame:
    """n rows of columns c0, c1, .. with about `values` different values each, made where they are needed by a hash of row, column and seed."""
    out = []
    for i, kind in enumerate(kinds):
        if kind not in KINDS:
            raise ValueError(f"no random values of {kind}")
        v = F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(values))
        out.append((v % 2 == 0 if kind == "boolean" else F.concat(F.lit("s"), v.cast("string")) if kind == "string" else v.cast(kind)).alias(f"c{i}"))
    return spark.range(n).select(*out)


def graph(spark: SparkSession, vertices: int, edges: int, *, seed: int = SEED) -> DataFrame:
    """src, dst, w: random edges, of which some may be equal or loops; weights are whole numbers from 1 to 10."""
    r = relation(spark, edges, ["bigint", "bigint"], values=vertices, seed=seed).toDF("src", "dst")
    return r.withColumn("w", (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(10)) + 1).cast("double"))


def expression(depth: int, names: Sequence[str] = ("x", "y"), *, seed: int = SEED) -> str:
    """A random arithmetic expression in text, fully bracketed."""
    rng = random.Random(seed)

    def grow(d: int) -> str:
        if d == 0 or rng.random() < 0.2:
            return rng.choice([*names, str(rng.randrange(4))])
        return f"({grow(d - 1)} {rng.choice('+-*')} {grow(d - 1)})"

    return grow(depth)
