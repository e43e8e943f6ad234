"""Substring dedup by hashing lines, cut further at sentence ends.

A unit ends after a line feed, or after white space that follows `.`, `!` or `?`. Units of fewer than min_words words are
never touched; others are normalised (A-Z lower-cased, white space runs as one space) and digested to 128 bits. Of equal
digests anywhere in the corpus the occurrence of least rank, (doc_id, offset), stays; the others go. Digests are summed
up before they are shuffled, so a unit that a third of all documents share is a few rows to its task; the table of
repeated digests is then joined back, where Spark may split a large partition.

With passages=True the exemption holds for runs, not units: from every unit on, and up to it, the shortest run of units of
min_words words is digested, so what stands in a repeated passage of that many words goes whatever the length of its
sentences or lines. The least occurrence of any unit stays: a run that goes has an equal one before it. Units of more than
LONG words are also cut before every word whose hash is the least among its NEAR neighbours on either side, wherever the unit
begins, and runs of FINE words between such cuts are digested too. So a passage without marks, or glued to other words, goes
but for what stands before its first and after its last cut; a repetition of one word has no such cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import scratch
from weftline.llm.kernels import IS_SPACE, RUN_BASES, U64, flat, mix, run_hashes, slices, word_hashes, word_starts

LONG, FINE, NEAR = 24, 16, 3
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True


def unit_table(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every unit: document row, start and end in bytes from the document's start, words, and two digests."""
    cut = b == 10
    cut[1:] |= IS_SPACE[b[1:]] & STOPS[b[:-1]]
    ends = np.unique(np.concatenate([np.flatnonzero(cut) + 1, o[1:][np.diff(o) > 0]]))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    row = np.searchsorted(o, starts, "right") - 1
    h, _ = word_hashes(b, o)
    at = np.searchsorted(word_starts(b, o), np.concatenate([starts, ends[-1:]]))
    n = np.diff(at)
    place = np.arange(len(h)) - np.repeat(at[:-1], n)
    digests = []
    for seed in SEEDS:
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(mix(h ^ U64(seed)) + place.astype(U64) * U64(seed | 1)), out=total[1:])
        digests.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(U64)).view(np.int64))
    return row, starts - o[row], ends - o[row], n, *digests


def run_pairs(at: np.ndarray, bounds: np.ndarray, o: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest runs of `least` words from each unit on and up to each unit, inside its document, as indices into bounds.

    bounds: ascending byte offsets of the units' starts and the last end; at: the words before each. Units without words
    neither start nor end a run.
    """
    unit = np.flatnonzero(np.diff(at))
    i = np.concatenate([unit, np.searchsorted(at, at[unit + 1] - least, "right") - 1])
    j = np.concatenate([np.searchsorted(at, at[unit] + least), unit + 1])
    there = (i >= 0) & (j < len(at))
    i, j = i[there], j[there]
    inside = bounds[j] <= o[np.searchsorted(o, bounds[i], "right")]
    both = np.unique(i[inside] * len(at) + j[inside])
    return both // max(len(at), 1), both % max(len(at), 1)


def word_cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word's hash is the least of its document's words up to NEAR places away."""
    g, row = mix(h ^ U64(0x165667B19E3779F9)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    cut = np.ones(len(h), bool)
    for d in range(1, NEAR + 1):
        apart = row[d:] != row[:-d]
        cut[d:] &= apart | (g[d:] < g[:-d])
        cut[:-d] &= apart | (g[:-d] <= g[d:])
    return cut


def run_table(b: np.ndarray, o: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every run: document row, start and end in bytes from the document's start, and two digests."""
    row, start, end, n, *_ = unit_table(b, o)
    bounds = np.concatenate([start + o[row], (end + o[row])[-1:]])
    at = np.concatenate([[0], np.cumsum(n)])[: len(bounds)]
    i, j = run_pairs(at, bounds, o, min_words)
    h, first = word_hashes(b, o)
    words = word_starts(b, o)
    inner = np.setdiff1d(words[word_cuts(h, first) & np.repeat(n > LONG, n)], bounds)
    fine = np.union1d(bounds, inner)
    k, m = run_pairs(np.searchsorted(words, fine), fine, o, FINE)
    before = np.concatenate([[0], np.cumsum(np.isin(fine, inner))])
    cut_inside = before[m + 1] > before[k]
    start, end = np.concatenate([bounds[i], fine[k[cut_inside]]]), np.concatenate([bounds[j], fine[m[cut_inside]]])
    i, j = np.searchsorted(words, start), np.searchsorted(words, end)
    row = np.searchsorted(o, start, "right") - 1
    digests = []
    for seed, base in zip(SEEDS, RUN_BASES, strict=True):
        digests.append(mix(run_hashes(mix(h ^ U64(seed)), i, j, base) + (j - i).astype(U64) * U64(seed | 1)).view(np.int64))
    return row, start - o[row], end - o[row], *digests


def units(docs: DataFrame, min_words: int, passages: bool = False) -> DataFrame:
    """doc_id, h (hash of the text), start, end, d1, d2 for the units (with passages: the runs of units) of min_words words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                if passages:
                    row, start, end, d1, d2 = run_table(*flat(part.column(1)), min_words)
                    keep = np.ones(len(row), bool)
                else:
                    row, start, end, n, d1, d2 = unit_table(*flat(part.column(1)))
                    keep = n >= min_words
                of = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(2).take(of), *(pa.array(x[keep]) for x in (start, end, d1, d2))], names=["doc_id", "h", "start", "end", "d1", "d2"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, start long, end long, d1 long, d2 long")


def repeats(docs: DataFrame, min_words: int = 8, passages: bool = False) -> DataFrame:
    """doc_id, h, spans (array of struct<start, end>): the units, or runs that may overlap, to remove from each document that has any."""
    found = units(docs, min_words, passages)
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"), F.count("*").alias("c")).where("c > 1").select("d1", "d2", "first")
    first = scratch(first, "first")
    later = found.join(first, ["d1", "d2"]).where(~F.struct("doc_id", "h", "start").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = max(at, e)
    out.append(data[at:])
    return b"".join(out)


def _of_row(h: str = "h"):
    """Whether marks (__d, h) are those of a row: of its doc_id and its text."""
    return F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col(h))


def dedup(docs: DataFrame, *, min_words: int = 8) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes), n_spans (removed units), spans ("start-end," in bytes of the original), kept_text, kept_sha256.

    One row for each row of `docs` (doc_id, text). Null texts count as empty. Rows that repeat a doc_id with the same text
    count as one document: its first occurrences stay in each of them; with other texts they are other documents, ranked by
    a hash of the text. Null doc_ids rank first.
    An empty table gives an empty result; other columns of `docs` are left out.
    """
    marks = repeats(docs, min_words).select(F.col("doc_id").alias("__d"), "h", "spans")
    joined = docs.select("doc_id", "text").join(marks, _of_row(), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b, o = flat(part.column(1))
                rows = []
                for i, found in enumerate(part.column(2).to_pylist()):
                    data = b[o[i] : o[i + 1]].tobytes()
                    spans = [(s["start"], s["end"]) for s in found or []]
                    kept = cut(data, spans)
                    rows.append((len(data), len(data) - len(kept), len(spans), "".join(f"{s}-{e}," for s, e in spans), kept.decode(), hashlib.sha256(kept).hexdigest()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept_text string, kept_sha256 string")


def without_repeats(docs: DataFrame, *, min_words: int = 8, passages: bool = False) -> DataFrame:
    """The rows of `docs` with the repeated units (or runs of units) cut out of text, and n_chars (if there is one) set to its new length.

    Texts of which only white space is left are dropped, null texts too. Other columns stay as they are.
    """
    marks = repeats(docs, min_words, passages).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    joined = docs.join(marks, _of_row("__h"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b, o = flat(part.column(text))
                kept = [cut(b[o[i] : o[i + 1]].tobytes(), [(s["start"], s["end"]) for s in found or []]).decode() for i, found in enumerate(part.column(len(names)).to_pylist())]
                columns = part.columns[: len(names)]
                columns[text] = pa.array(kept, pa.string())
                if chars is not None:
                    columns[chars] = pa.array(map(len, kept), columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([bool(k.strip(" \t\n\x0b\f\r")) for k in kept], pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
