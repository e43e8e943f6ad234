"""Statistics for plans: equi-width histograms and approximate distinct counts, computed by Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Histogram:
    """Counts in equally wide buckets of [low, high]; selectivities interpolate inside a bucket."""

    low: float
    high: float
    counts: tuple[int, ...]

    @staticmethod
    def of(df: DataFrame, column: str, buckets: int = 10, low: float | None = None, high: float | None = None) -> Histogram:
        """One pass of width_bucket and count (two if the bounds are not given); nulls and values outside are left out."""
        if low is None or high is None:
            r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
            low, high = (low if low is not None else r["lo"] or 0.0), (high if high is not None else r["hi"] or 0.0)
        counts = [0] * buckets
        v = F.col(column)
        if low < high:
            bucket = F.least(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(buckets)), F.lit(buckets))
        else:
            bucket = F.lit(1)
        for r in df.where(v.between(low, high)).groupBy(bucket.alias("b")).count().collect():
            counts[r["b"] - 1] += r["count"]
        return Histogram(float(low), float(high), tuple(counts))

    @property
    def total(self) -> int:
        return sum(self.counts)

    def at_most(self, x: float) -> float:
        """Share of values <= x."""
        if not self.total or x < self.low:
            return 0.0
        if x >= self.high:
            return 1.0
        width = (self.high - self.low) / len(self.counts)
        b = min(int((x - self.low) / width), len(self.counts) - 1)
        inside = (x - self.low - b * width) / width
        return (sum(self.counts[:b]) + inside * self.counts[b]) / self.total

    def between(self, a: float, b: float) -> float:
        return max(0.0, self.at_most(b) - self.at_most(a))


def distinct_estimate(df: DataFrame, column: str, precision: int = 12) -> int:
    """HyperLogLog with 2**precision registers (4 to 16); sketches merge with hll_union_agg."""
    if not 4 <= precision <= 16:
        raise ValueError("precision is from 4 to 16")
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, precision)).alias("n")).first()["n"]
