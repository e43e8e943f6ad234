"""Vector best-fit packing on a histogram of lengths.

Pieces of one length are one vector: its tokens, one document, and its attention cost (the square of its length). So the
packing is decided for lengths, not for pieces: bins that agree in residual capacities are one range of bin numbers, and
from the longest length down each length's count is laid into the range that scores best, as many bins as it needs, until
the count is used up; what fits nowhere opens bins. The score is the weighted dot product of the piece and the residual
(larger is better), or the norm of the residual that would remain (smaller is better); every capacity must hold. The
plan is bounded by the capacity, not by the corpus. Pieces then find their places in it by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, rank_within, scratch
from weftline.llm.kernels import slices
from weftline.llm.tokens import ENCODED_BYTES, encoder, vocabulary, with_end


@dataclass(frozen=True)
class Capacity:
    """Limits of a bin and the weights of its three dimensions; None sets no limit."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


@dataclass
class _Bins:
    first: int
    count: int
    used: tuple[int, int, int] = field(default=(0, 0, 0))


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank of the first piece, pieces, first bin, pieces of this length in a bin, offset) for each laying."""
    caps = (capacity.tokens, capacity.documents or capacity.tokens, capacity.attention or capacity.tokens**2)

    def vector(n: int, k: int = 1) -> tuple[int, int, int]:
        return (k * n, k, k * n * n)

    def room(b: _Bins) -> tuple[int, ...]:
        return tuple(c - u for c, u in zip(caps, b.used, strict=True))

    def score(b: _Bins, n: int) -> float:
        left, v = room(b), vector(n)
        if capacity.rule == "dot":
            return sum(w * x * r / c / c for w, x, r, c in zip(capacity.weights, v, left, caps, strict=True))
        return -sum(w * ((r - x) / c) ** 2 for w, x, r, c in zip(capacity.weights, v, left, caps, strict=True))

    by_state: dict[tuple[int, int, int], list[_Bins]] = {}
    bins, out = 0, []
    for n in sorted(histogram, reverse=True):
        left, rank = histogram[n], 0
        v = vector(n)
        if any(x > c for x, c in zip(v, caps, strict=True)):
            raise ValueError(f"a piece of {n} tokens fits no empty bin")
        while left:
            fits = [s for s in by_state if all(u + x <= c for u, x, c in zip(s, v, caps, strict=True))]
            if fits:
                state = max(fits, key=lambda s: (score(_Bins(0, 1, s), n), s))
                b = by_state[state].pop()
                if not by_state[state]:
                    del by_state[state]
                take = min(left, b.count)
                out.append((n, rank, take, b.first, 1, b.used[0]))
                if take < b.count:
                    by_state.setdefault(state, []).append(_Bins(b.first + take, b.count - take, state))
                b = _Bins(b.first, take, tuple(u + x for u, x in zip(state, v, strict=True)))
            else:
                per = min(c // x for x, c in zip(v, caps, strict=True))
                if left < per:
                    per = left
                take = left // per * per
                out.append((n, rank, take, bins, per, 0))
                b = _Bins(bins, take // per, vector(n, per))
                bins += b.count
            by_state.setdefault(b.used, []).append(b)
            left -= take
            rank += take
    return out


def pieces(docs: DataFrame, tokenizer: str, tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; only documents of more than `tokens` ids are cut, the first piece taking the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                ids, at = with_end(*encode(part.column(1)))
                data = memoryview(ids.astype("<u4")).cast("B")
                n = np.diff(at)
                head = np.where(n % tokens == 0, tokens, n % tokens)
                count = 1 + (n - head) // tokens
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * tokens)
                length = np.where(piece == 0, head[row], tokens)
                begin = (at[row] + start).tolist()
                crc = [zlib.crc32(data[4 * b : 4 * (b + k)]) for b, k in zip(begin, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: Capacity | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of `docs` (doc_id, text).

    Null and empty texts are one end id. Null doc_ids and repeated rows are packed like others. An empty table gives an
    empty result; other columns are left out.
    """
    capacity = capacity or Capacity()
    spark = docs.sparkSession
    found = scratch(pieces(docs, tokenizer or vocabulary("byte_bpe_50k.json"), capacity.tokens), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # `tokens` rows at most
    laid = plan(histogram, capacity)
    if not laid:
        return found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    ranked = rank_within(found, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank", 4 * partitions(spark))
    table: dict[int, list[tuple[int, ...]]] = {}
    for n, *rest in laid:
        table.setdefault(n, []).append(tuple(rest))
    shared = spark.sparkContext.broadcast({n: np.array(rows, np.int64) for n, rows in table.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            if not len(n):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], n[order][1:] != n[order][:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
                rows = order[a:b]
                length = int(n[rows[0]])
                steps = shared.value[length]
                at = np.searchsorted(steps[:, 0], rank[rows], "right") - 1
                k = rank[rows] - steps[at, 0]
                sequence[rows] = steps[at, 2] + k // steps[at, 3]
                offset[rows] = steps[at, 4] + k % steps[at, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
