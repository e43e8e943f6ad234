"""Spark plumbing shared by the text operators: gapless ranks, connected components, scratch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import drop_scratch, scratch, scratch_path

__all__ = ["components", "drop_scratch", "let", "partitions", "rank_within", "scratch", "scratch_path"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, buckets: int) -> DataFrame:
    """Adds `out`: a gapless rank from 0 within each value of `keys`.

    A key's rows are dealt to `buckets` hash buckets of `order`; a window ranks inside a bucket, and a prefix sum over
    the bucket counts (`buckets` rows a key at most) gives its offset. No task holds a key's rows whole. Rows that agree
    in all of `order` may swap ranks. Null keys make one group; an empty table stays empty.
    """
    b, n, off, r = "__bucket", "__n", "__off", "__r"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, b).agg(F.count("*").alias(n))
    before = F.sum(n).over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn(off, F.coalesce(before, F.lit(0))).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(b).alias("__kb"), off)
    ranked = rows.withColumn(r, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
    same = (F.col(b) == F.col("__kb"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return ranked.join(offsets, same).withColumn(out, F.col(off) + F.col(r) - 1).drop(b, n, off, r, "__kb", *[f"__k_{k}" for k in keys])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, comp): the smallest node that each node of `edges` reaches, whatever the edges' direction.

    Minimum labels travel along edges and through pointer jumps, so chains shorten by halves; every round is joins and
    aggregates on tables of two columns, cut off by a scratch table. Nothing is gathered on the driver but one flag.
    """
    both = scratch(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    labels = scratch(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        step = labels.join(near, labels.node == near.u).select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("was"))
        step, old = scratch(step, "labels"), labels
        up = step.select(F.col("node").alias("p"), F.col("comp").alias("pc"))
        new = scratch(step.join(up, step.comp == up.p, "left").select("node", F.coalesce("pc", "comp").alias("comp"), (F.coalesce("pc", "comp") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "comp")
        settled = new.where("moved").isEmpty()
        drop_scratch(both.sparkSession, step, old, *([both] if settled else []))
        if settled:
            return labels
        labels._scratch = new._scratch
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body uses it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]
