"""Positions, selections and vectors: rows by gapless index, tuples as structs and arrays, hashes and hash partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import scratch

_LOW = (1 << 33) - 1


def with_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Adds a gapless position from 0 in the given order. Rows that tie may swap.

    Rows are range-dealt and sorted; a position is the place in the task plus the rows of the tasks before. One number for
    each task is summed up, no row is gathered.
    """
    ranged = scratch(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("__m", 33)
    counts = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))  # a row for each task
    placed = ranged.withColumn("__q", part).join(F.broadcast(before), F.col("__q") == F.col("__p"))
    return placed.withColumn(name, F.col("__off") + F.col("__m").bitwiseAND(F.lit(_LOW))).drop("__m", "__q", "__p", "__off")


def filter_indices(df: DataFrame, order: Sequence[str], cond: Column) -> DataFrame:
    """index: positions, in the given order, of the rows for which the condition holds."""
    return with_index(df.select(*order, cond.alias("__c")), order).where("__c").select("index")


def at_indices(df: DataFrame, order: Sequence[str], indices: DataFrame) -> DataFrame:
    """The rows at the given positions (a column index), with their position."""
    return with_index(df, order).join(indices.select("index").distinct(), "index", "left_semi")


def place_of(df: DataFrame, column: str, value: object) -> DataFrame:
    """found, place: a binary search's answer without a search: whether the value is there, and how many values are smaller (nulls are left out)."""
    v = F.col(column)
    return df.agg(F.coalesce(F.bool_or(v == F.lit(value)), F.lit(False)).alias("found"), F.count(F.when(v < F.lit(value), 1)).alias("place"))


def sorted_vector(values: Column, *, nulls_last: bool = True) -> Column:
    """An array in ascending order; array_sort puts nulls last, sort_array first."""
    return F.array_sort(values) if nulls_last else F.sort_array(values)


def dictionary_size(df: DataFrame, column: str) -> DataFrame:
    """size: different values of a column, null not counted."""
    return df.agg(F.count_distinct(column).alias("size"))


def project(row: Column, *places: int) -> Column:
    """Fields of an array by place."""
    return F.array(*[F.get(row, F.lit(p)) for p in places])


def prefix(row: Column, n: int) -> Column:
    return F.slice(row, 1, n)


def suffix(row: Column, n: int) -> Column:
    """The last n fields, or all if there are fewer."""
    return F.slice(row, F.greatest(F.size(row) - n, F.lit(0)) + 1, n)


def concat(*rows: Column) -> Column:
    return F.concat(*rows)


def as_type(value: Column, kind: str) -> Column:
    """A value as bigint, double, string or boolean; one that cannot be read so raises, null stays null."""
    return value.cast(kind)


def hash31(text: Column) -> Column:
    """The string hash s[0]*31**(n-1) + .. of code units below 2**16, as a signed 32-bit number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit((1 << 32) - 1)))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def partition_of(keys: Sequence[str], n: int) -> Column:
    """The hash partition, 0 to n - 1, of a row's keys: a 64-bit mixing hash, so near keys lie apart. Null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def split_batch(df: DataFrame, keys: Sequence[str], n: int) -> list[DataFrame]:
    """The rows in n lots by hash of the keys, each a lazy filter."""
    return [df.where(partition_of(keys, n) == i) for i in range(n)]


def window_functions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """Adds row_number, rank, dense_rank, lag, lead and running (the sum up to the row) of value, by key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"row_number": F.row_number().over(w), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "lag": F.lag(value).over(w), "lead": F.lead(value).over(w), "running": running})
