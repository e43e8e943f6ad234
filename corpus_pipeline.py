"""A corpus pipeline over the text operators: quality rules, near-dedup, substring dedup, decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, to be written as Parquet
and read again as the next one's docs. All but the last return the columns of `docs`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, near_dup, packing, quality_rules, substring_dedup
from weftline.llm.common import scratch
from weftline.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from `labels`; the others go."""
    return quality_rules.passing(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that with the smallest doc_id.

    Rows without a doc_id, or of one doc_id and different texts, are documents of their own; of rows that agree in both one stays.
    """
    return near_dup.deduplicated(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, sentences and runs of short ones that an earlier document (or place) holds; n_chars is that of the new text.

    Documents of which nothing but white space is left are dropped.
    """
    return substring_dedup.without_repeats(docs, passages=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the words of every benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, capacity=packing.Capacity(tokens=1024))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: Learned rules, tilings and tokens are beyond SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written to the shared folder and read again."""
    ship(spark)
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, "stage-" + name.replace(" ", "-"))
    return docs
