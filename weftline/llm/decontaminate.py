"""Benchmark decontamination by greedy string tiling.

Benchmark items come in blocks of a bounded number of words, each block sent to the workers once. Karp-Rabin hashes of
width-word windows run over the documents and join the items' seeds; chains of seeds on a diagonal are the maximal
matches of a document and an item. The longest match whose words are all free is marked as a tile again and again (a
match that is partly taken is cut to its free parts), so passages count wherever and in whatever order they stand. The
share of an item's words under tiles is its coverage.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.kernels import U64, WORD_CODE, flat, mix, ranges, slices, word_hashes

BLOCK_WORDS = 1_000_000
#: Seed pairs that are in memory at once; a document that repeats an item's words a million times has many more.
PAIRS = 2_000_000


def windows(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words that lies in one document, and its first word."""
    s = np.zeros(max(0, len(h) - width + 1), U64)
    for j in range(width):
        s += h[j : j + len(s)] * WORD_CODE[j]
    inside = np.ones(len(s), bool)
    for j in range(1, width):
        crossed = at[1:-1] - j
        inside[crossed[(crossed >= 0) & (crossed < len(s))]] = False
    first = np.flatnonzero(inside)
    return mix(s[first]), first


def chains(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of n seeds each (i in the document, j in the item) put together where one follows another on its diagonal, by document, item and diagonal."""
    order = np.lexsort((i, j - i, item, doc))
    doc, item, i, j, n = doc[order], item[order], i[order], j[order], n[order]
    if not len(i):
        return doc, item, i, j, n
    new = np.ones(len(i), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != i[:-1] + n[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], item[starts], i[starts], j[starts], np.add.reduceat(n, starts)


def tiles(i: np.ndarray, j: np.ndarray, width: int, n: np.ndarray | None = None, words: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of the matches that the seeds (i in the document, j in the item; or runs of n seeds) make: (length, i, j) of each tile.

    Ties go to the earliest place in the document, then in the item. With `words`, the item's size, it ends as soon as
    too few of them are free for another tile.
    """
    zero = np.zeros(len(i), np.int64)
    _, _, i, j, n = chains(zero, zero, i, j, np.ones(len(i), np.int64) if n is None else n)
    heap = [(-k, a, b) for k, a, b in zip((n + width - 1).tolist(), i.tolist(), j.tolist(), strict=True)]
    heapq.heapify(heap)
    taken_i: set[int] = set()
    taken_j: set[int] = set()
    out = []
    while heap and (words is None or words - len(taken_j) >= width):
        n, a, b = heapq.heappop(heap)
        free = [a + k not in taken_i and b + k not in taken_j for k in range(-n)]
        if all(free):
            taken_i.update(range(a, a - n))
            taken_j.update(range(b, b - n))
            out.append((-n, a, b))
            continue
        k = 0
        while k < -n:
            m = k
            while m < -n and free[m]:
                m += 1
            if m - k >= width:
                heapq.heappush(heap, (k - m, a + k, b + k))
            k = m + 1
    return out


class Items:
    """A block of items ready to be matched: seeds of one width, sorted, with item and place."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str], width: int) -> None:
        h, at = word_hashes(*flat(pa.array(texts, pa.string())))
        self.ids, self.words = list(ids), np.diff(at)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        widths = np.minimum(self.words, width)
        for w in sorted(set(widths[widths > 0].tolist())):
            s, first = windows(h, at, w)
            item = np.searchsorted(at, first, "right") - 1
            use = widths[item] == w
            order = np.argsort(s[use], kind="stable")
            self.seeds[w] = s[use][order], item[use][order], (first - at[item])[use][order]

    def covered(self, h: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, words under tiles, tiles) where that is at least `least` of the item's words."""
        for w, (seeds, items, places) in self.seeds.items():
            s, first = windows(h, at, w)
            lo = np.searchsorted(seeds, s, "left")
            hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == s)
            n = np.searchsorted(seeds, s[hit], "right") - lo[hit]
            parts = []
            total = np.cumsum(n)
            at_hit = 0
            while at_hit < len(hit):  # as many seed pairs at a time as PAIRS allows, kept as runs
                done = total[at_hit - 1] if at_hit else 0
                to = max(at_hit + 1, int(np.searchsorted(total, done + PAIRS, "right")))
                some, k = hit[at_hit:to], n[at_hit:to]
                take = ranges(lo[some], k)
                i, item, j = np.repeat(first[some], k), items[take], places[take]
                parts.append(chains(np.searchsorted(at, i, "right") - 1, item, i, j, np.ones(len(i), np.int64)))
                at_hit = to
            if not parts:
                continue
            doc, item, i, j, n = parts[0] if len(parts) == 1 else chains(*map(np.concatenate, zip(*parts, strict=True)))
            cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
            for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                d, q = int(doc[a]), int(item[a])
                words = int(self.words[q])
                need = least * words - 1e-9
                edge = np.zeros(words + 1, np.int64)
                np.add.at(edge, j[a:b], 1)
                np.add.at(edge, j[a:b] + n[a:b] + w - 1, -1)
                if (np.cumsum(edge) > 0).sum() >= need:
                    found = tiles(i[a:b], j[a:b], w, n[a:b], words)
                    if (covered := sum(t[0] for t in found)) >= need:
                        yield d, q, covered, len(found)


def blocks(benchmark: DataFrame, width: int, most_words: int) -> Iterator[Items]:
    """The benchmark in blocks of at most most_words words (one longer item makes its own), read from Spark row by row."""
    ids, texts, size = [], [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        n = len(r["text"].split())
        if ids and size + n > most_words:
            yield Items(ids, texts, width)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield Items(ids, texts, width)


def leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, least: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, covered, n_tiles, coverage: the items of which a document holds `least` of the words or more.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Items of fewer than `width` words match
    as a whole. Null or wordless texts match nothing. Repeated rows are reported again each. Empty tables give an empty
    result; other columns are left out.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, covered long, n_tiles long, coverage double"
    out = None
    for block in blocks(benchmark, width, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(items.covered(*word_hashes(*flat(part.column(1))), least))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[2] / int(items.words[f[1]]) for f in found], pa.float64())],
                        names=["doc_id", "item_id", "covered", "n_tiles", "coverage"],
                    )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, least: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` that `leaks` would not report, with all their columns; each is judged where it is read, without a shuffle."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, width, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[f[0] for f in shared.value.covered(*word_hashes(*flat(part.column(at))), least)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
