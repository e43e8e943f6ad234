"""Windows, sessions and interval joins over streams; each works on a batch DataFrame too and then gives the batch result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_time(df: DataFrame, time: str, lateness: str | None) -> DataFrame:
    """Time as a timestamp (watermarks need one), with a watermark if lateness is given; without one nothing is ever late."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df if lateness is None else df.withWatermark(time, lateness)


def tumbling_counts(df: DataFrame, time: str, size: str, keys: Sequence[str] = (), lateness: str | None = None, **aggs: Column) -> DataFrame:
    return sliding_counts(df, time, size, size, keys, lateness, **aggs)


def sliding_counts(df: DataFrame, time: str, size: str, slide: str, keys: Sequence[str] = (), lateness: str | None = None, **aggs: Column) -> DataFrame:
    """start, end, keys, events and any further aggregates for each window."""
    w = F.window(time, size, slide) if size != slide else F.window(time, size)
    out = on_time(df, time, lateness).groupBy(w.alias("__w"), *keys).agg(F.count("*").alias("events"), *[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, "events", *aggs)


def session_counts(df: DataFrame, time: str, gap: str, keys: Sequence[str], lateness: str | None = None) -> DataFrame:
    """keys, start, end (time of the last event), events."""
    out = on_time(df, time, lateness).groupBy(*keys, F.session_window(time, gap).alias("__w")).agg(F.count("*").alias("events"), F.max(time).alias("end"))
    return out.select(*keys, F.col("__w.start").alias("start"), "end", "events")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, lower: str, upper: str, lateness: str | None = None) -> DataFrame:
    """Left columns, then right ones prefixed r_: same key and left - lower <= right <= left + upper. Watermarks bound the state of a stream."""
    a = on_time(left, left_time, lateness)
    b = on_time(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), f"r_{right_time}", lateness)
    lt, rt = F.col(left_time), F.col(f"r_{right_time}")
    return a.join(b, (F.col(key) == F.col(f"r_{key}")) & (rt >= lt - F.expr(f"INTERVAL {lower}")) & (rt <= lt + F.expr(f"INTERVAL {upper}")))
