"""URL filters as a sort-merge range join.

A host is turned round ("en.example.org" becomes "org.example.en."), so a rule's host and all its subdomains are one
interval of keys. URLs and rules are dealt to key ranges, sorted, and swept once: a stack holds the intervals that are
open at the current key, nested by construction, and each keeps its path prefixes in order. A rule goes to every range
that its interval meets; intervals nest, so besides its own range a range gets the rules around its lower end alone.
Range bounds come from a bounded sample of (key, salt) pairs and touch only the balance, not the result; the salt is a hash of
the row, so bounds cut between rows of one key too, and a hot host or a hot URL spreads over many ranges. The sample is
drawn by another hash than the salt. Each range is a partition of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions

#: Sorts after every character.
LAST = "\U0010ffff"


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty for a null url or one without "://"."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    rest = F.when(F.instr("url", "://") > 0, rest).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")))


def key_of(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


class Sweep:
    """Open intervals while keys ascend. open() takes rules in key order, longer intervals first; best() answers for a key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, list[tuple[str, str]]]] = []

    def _advance(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self._advance(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, []))
        rules = self.stack[-1][2]
        at = bisect_right(rules, (path, verdict))
        if not at or rules[at - 1] != (path, verdict):
            rules.insert(at, (path, verdict))

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest rule; of equally long ones that with the longer host, of equal rules block."""
        self._advance(key)
        found, size = None, -1
        for _, host, rules in reversed(self.stack):
            probe = path
            while True:
                at = bisect_right(rules, (probe, LAST)) - 1
                if at < 0:
                    break
                prefix, verdict = rules[at]
                if path.startswith(prefix):
                    if len(host) + len(prefix) > size:
                        found, size = (host + prefix, verdict), len(host) + len(prefix)
                    break
                common = 0
                while common < min(len(prefix), len(path)) and prefix[common] == path[common]:
                    common += 1
                probe = path[:common]
        return found


class Bounds:
    """Ascending (key, salt) pairs between ranges."""

    def __init__(self, pairs: Sequence[tuple[str, int]]) -> None:
        self.keys = np.array([k for k, _ in pairs], object)
        self.salts = np.array([s for _, s in pairs], np.int64)

    def below(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """How many bounds are at most each pair."""
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for a in np.unique(lo[hi > lo]).tolist():  # keys that are bounds themselves: the salts decide
            rows = np.flatnonzero((lo == a) & (hi > lo))
            lo[rows] += np.searchsorted(self.salts[a : hi[rows[0]]], salts[rows], "right")
        return lo


def _dealt(urls: DataFrame, rules: DataFrame, count: int, bounds_from: int) -> DataFrame:
    """Urls (kind 1) and rules (kind 0) with the range that each goes to; a rule goes to all that its interval meets."""
    kind = urls.schema["page_id"].dataType.simpleString()
    few = urls.select("key", "salt").orderBy(F.xxhash64("salt", F.lit("sample"))).limit(max(bounds_from, 32 * count)).agg(F.collect_list(F.struct("key", "salt")).alias("few"))
    seen = sorted((r["key"], r["salt"]) for r in few.first()["few"])  # picked on the executors, sent once
    bounds = Bounds([seen[len(seen) * i // count] for i in range(1, count)] if seen else [])

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.array(batch.column("key").to_pylist(), object), batch.column("salt").to_numpy()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bounds.below(*columns(b)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "range"])

    def all_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, salts = columns(b)
            lo, hi = bounds.below(keys, salts), bounds.below(keys + LAST, np.full(len(keys), 2**63 - 1))
            row = np.repeat(np.arange(len(lo)), hi - lo + 1)
            at = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(at.astype(np.int32))], names=[*b.schema.names, "range"])

    schema = f"page_id {kind}, host string, path string, verdict string, key string, salt long, kind int, range int"
    left = urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), "key", "salt", F.lit(1).alias("kind")).mapInArrow(each, schema)
    right = rules.select(F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict", "key", F.lit(-(2**63)).alias("salt"), F.lit(0).alias("kind")).mapInArrow(all_met, schema)
    return left.unionByName(right)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, *, default: str = "allow", ranges: int | None = None, bounds_from: int = 5_000) -> DataFrame:
    """page_id, host, path, rule, verdict; one row for each row of `pages` (page_id, url).

    rules: (host, path, verdict) rows, or a DataFrame of those columns. A rule fits its host and its subdomains where the
    path starts with its own; the longest wins. Urls that no rule fits get `default` and a null rule, so do null urls.
    Repeated rows stay repeated; empty tables give empty results; other columns of `pages` are left out.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    turned = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    urls = with_host_path(pages.select("page_id", "url")).select("page_id", "host", "path", turned.alias("key"), F.xxhash64("page_id", "url").alias("salt"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select("host", "path", "verdict", turned.alias("key"))
    count = ranges or partitions(spark)
    swept = _dealt(urls, rules, count, bounds_from).repartitionById(count, F.col("range")).sortWithinPartitions("key", "kind", "path", F.desc("verdict"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text = Sweep(), pa.string()
        for b in batches:
            kinds, keys, paths = b.column("kind").to_numpy(), b.column("key").to_pylist(), b.column("path").to_pylist()
            hosts, verdicts = b.column("host"), b.column("verdict")
            found: list[tuple[str | None, str]] = []
            last = None
            for i, kind in enumerate(kinds.tolist()):
                if kind == 0:
                    now.open(keys[i], hosts[i].as_py(), paths[i], verdicts[i].as_py())
                    continue
                if last is None or (keys[i], paths[i]) != last:  # once for equal urls; rules come before the urls of their key
                    last, best = (keys[i], paths[i]), now.best(keys[i], paths[i]) or (None, default)
                found.append(best)
            urls = pa.RecordBatch.filter(b, pa.array(kinds == 1))
            yield pa.RecordBatch.from_arrays([urls.column("page_id"), urls.column("host"), urls.column("path"), pa.array([r for r, _ in found], text), pa.array([v for _, v in found], text)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = swept.schema["page_id"].dataType.simpleString()
    return swept.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
