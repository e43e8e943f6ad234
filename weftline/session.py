"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the path it has here, for sessions that were started without it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


_made: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            return


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own where that is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.weftline.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.weftline.scratch", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


#: Spark then removes an action's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def counted(df: DataFrame, label: str, *, placed: bool = False) -> tuple[DataFrame, int]:
    """A scratch table and its rows, counted by the job that writes it."""
    seen = Observation()
    out = scratch(df.observe(seen, F.count(F.lit(1)).alias("n")), label, placed=placed)
    return out, seen.get["n"]


def _paths(df: DataFrame) -> list[str]:
    return getattr(df, "_parts", None) or [df._scratch]


#: Tables that are read as one at most; beyond, they are written as one.
MOST_PARTS = 32


def joined_parts(parts: list[DataFrame]) -> DataFrame:
    """Scratch tables of one schema (or what this made of some) read as one, without writing them again; in buckets if all are in the same."""
    if len(parts) == 1:
        return parts[0]
    paths = [p for df in parts for p in _paths(df)]
    buckets = {buckets_of(df) for df in parts}
    if len(buckets) == 1 and None not in buckets:
        key, n = buckets.pop()
        out = _read_buckets(parts[0], paths, key, n)
        return dealt(out, key, n, "joined", placed=True) if len(paths) > MOST_PARTS else out
    out = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)
    if len(paths) > MOST_PARTS:
        return scratch(out, "joined")
    out._parts = paths
    return out


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    was = {k: spark.conf.get(k, "false") for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def is_scratch(df: DataFrame) -> bool:
    return hasattr(df, "_scratch") or hasattr(df, "_parts")


def scratch(df: DataFrame, label: str, *, placed: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs only its own tasks.

    placed: joins on more columns than the one that both sides are dealt by leave them where they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _settings(spark, **{CLEANUP: "true"} | ({PLACED: "false"} if placed else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Whether a join wants both sides dealt by all of its keys, not by some of them.
PLACED = "spark.sql.requireAllClusterKeysForCoPartition"


def dealt(df: DataFrame, key: str, n: int, label: str, *, placed: bool = False) -> DataFrame:
    """A scratch table in n buckets of a column: joins with what is dealt by that column into n read it where it lies, and nothing moves it again.

    placed: df is dealt so already. Where it is not, only more files come of it.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, label), f"spark_catalog.default.weftline_{uuid.uuid4().hex}"
    with _settings(spark, **{CLEANUP: "true", PLACED: "false"}):
        rows = df if placed else df.repartition(n, key)
        try:  # only a table can be written in buckets; its entry goes at once, the files stay
            rows.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return _read_buckets(df, [path], key, n)


def _read_buckets(like: DataFrame, paths: list[str], key: str, n: int) -> DataFrame:
    """Files in n buckets of a column as one table of like's columns."""
    spark = like.sparkSession
    jvm, js = spark._jvm, spark._jsparkSession
    seq, some = jvm.org.apache.spark.api.python.PythonUtils.toSeq, jvm.scala.Option.apply
    sql = jvm.org.apache.spark.sql
    buckets = sql.catalyst.catalog.BucketSpec(n, seq([key]), seq([]))
    schema = sql.types.DataType.fromJson(like.schema.json())
    options = jvm.org.apache.spark.api.python.PythonUtils.toScalaMap({})
    source = sql.execution.datasources.DataSource(js, "parquet", seq(paths), some(schema), seq([]), some(buckets), options, some(None))
    out = DataFrame(js.baseRelationToDataFrame(source.resolveRelation(False, True)), spark)
    out._parts, out._buckets = paths, (key, n)
    return out


def buckets_of(df: DataFrame) -> tuple[str, int] | None:
    """The column and the number of buckets that a scratch table lies in."""
    return getattr(df, "_buckets", None)


def without(df: DataFrame, column: str) -> DataFrame:
    """A table in buckets without one of its columns, still in buckets."""
    return _read_buckets(df.drop(column), df._parts, *df._buckets)


def drop_scratch(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes scratch tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _made.pop(path, None)
