"""Durability on Spark's own readers and writers.

The change log is a Parquet folder of records (epoch, seq, pred, row as JSON, weight) with a CRC32 of each; the batch that a
crash cut short never becomes visible, as files are committed by rename. Snapshots are one Parquet table a predicate.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "epoch long, seq long, pred string, row string, weight long, crc long"


class CorruptLog(ValueError):
    pass


def _crc():
    return F.crc32(F.encode(F.to_json(F.struct("epoch", "seq", "pred", "row", "weight")), "UTF-8"))


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, records: Iterable[tuple[int, str, tuple, int]]) -> None:
        """Adds (epoch, predicate, row, weight) records in order, as one committed batch."""
        rows = [(e, i, p, json.dumps(list(r)), w) for i, (e, p, r, w) in enumerate(records)]
        if rows:
            self.append_frame(self.spark.createDataFrame(rows, "epoch long, seq long, pred string, row string, weight long").coalesce(1))

    def append_frame(self, df: DataFrame) -> None:
        df.select("epoch", "seq", "pred", "row", "weight").withColumn("crc", _crc()).write.mode("append").parquet(self.path)

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def frame(self) -> DataFrame:
        """The records; reading a row that fails its CRC raises."""
        failed = F.raise_error(F.format_string("record %d of epoch %d fails its CRC", F.col("seq"), F.col("epoch"))).cast("string")
        return self._raw().withColumn("row", F.when(F.col("crc").eqNullSafe(_crc()), F.col("row")).otherwise(failed))

    def replay(self) -> DataFrame:
        """All records by epoch and place; a record that fails its CRC raises."""
        df = self._raw()
        bad = df.where(~F.col("crc").eqNullSafe(_crc())).limit(1).collect()
        if bad:
            raise CorruptLog(f"record {bad[0]['seq']} of epoch {bad[0]['epoch']} fails its CRC")
        return df.orderBy("epoch", "seq").select("epoch", "pred", "row", "weight")

    def state(self, pred: str, schema: str, until: int | None = None) -> DataFrame:
        """The rows of a predicate with positive weight as of an epoch; schema names and types its columns."""
        df = self.frame().where(F.col("pred") == pred)
        if until is not None:
            df = df.where(F.col("epoch") <= until)
        held = df.groupBy("row").agg(F.sum("weight").alias("w")).where("w > 0")
        fields = [f.split()[:2] for f in schema.split(",")]
        parts = F.from_json("row", "array<string>")
        return held.select(*[F.get(parts, i).cast(k).alias(n) for i, (n, k) in enumerate(fields)])


def save_snapshot(path: str, relations: dict[str, DataFrame]) -> None:
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations by name; a folder that is missing is an empty snapshot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in sorted(names)}


@dataclass(frozen=True)
class Relation:
    name: str
    columns: tuple[tuple[str, str], ...]
    base: bool = True

    @property
    def arity(self) -> int:
        return len(self.columns)


class Catalog:
    """Schemas by name; relations with data are temporary views of the session too."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark, self.held = spark, {}

    def register(self, relation: Relation, df: DataFrame | None = None) -> None:
        self.held[relation.name] = relation
        if df is not None:
            df.createOrReplaceTempView(relation.name)

    def get(self, name: str) -> Relation | None:
        return self.held.get(name)

    def all(self) -> list[Relation]:
        return list(self.held.values())

    def has(self, name: str) -> bool:
        return name in self.held

    def clear(self) -> None:
        if self.spark is not None:
            for name in self.held:
                self.spark.catalog.dropTempView(name)
        self.held = {}


def read_program(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def read_table(spark: SparkSession, path: str, format: str | None = None, **options: str) -> DataFrame:
    """A table by its suffix (parquet, orc, csv with a header, json) or a named Spark source."""
    kind = format or path.rsplit(".", 1)[-1]
    reader = spark.read.options(**options)
    if kind == "csv":
        return reader.option("header", options.get("header", "true")).csv(path)
    return reader.format(kind).load(path)
