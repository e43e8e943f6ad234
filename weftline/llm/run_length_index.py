"""Suffix-array dedup with a run-length index.

Which bytes lie in a string of `least` bytes that starts elsewhere too? Every such string holds a least gram (of q bytes,
by hash), and equal strings hold it at the same place. So string starts are dealt by that fingerprint: a segment is the
stretch of text around one fingerprint occurrence that its strings span, and equal strings always meet in one fingerprint's
segments. Equal segments are aggregated first (their strings are repeated by that alone); fingerprints that occur once drop out.

The different segments of the other fingerprints are indexed in blocks of bounded size: suffixes are sorted, the
Burrows-Wheeler transform is kept as runs, and text places are sampled at the run ends, with the length of the match across
each border of runs. Longest matches inside a run follow from those at its ends, so streaming over the text from the sampled
ends yields the matching statistics of every place, and places of `least` or more are marked. Besides the text the index
holds a few numbers for each run; suffix ranks are dropped once it is built.

A fingerprint whose different segments exceed an index (MOST bytes) is dealt again by more of its strings: starts are cut
into steps of STEP by their distance from the fingerprint, and pieces meet by the digest of what all strings of a step have
in common. Equal pieces are aggregated, others indexed as before; a common part that is too large even so (its pieces
differ in fewer than STEP bytes on either side alone) has its strings digested one by one, which splits any such group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_scratch, partitions, scratch
from weftline.llm.kernels import BASE_INV, U64, flat, mix, powers, prefix_hash, ragged, slices

LEAST, GRAM = 400, 64
BLOCK, STEP = 1 << 20, 16
#: The different segments of one fingerprint that an index takes, in bytes and end marks; an index ends at 2**21.
MOST = 1_900_000
_IX = 21
_POS = 28


def owners(b: np.ndarray, o: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one fingerprint: its place, the first and the last start (in b), the fingerprint."""
    n, w = len(b), least - gram + 1
    if n < least:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    p = prefix_hash(b)
    g = mix((p[gram:] - p[:-gram]) * powers(BASE_INV, n)[: n - gram + 1])
    m = len(g)
    key = np.full(-(-m // w) * w, U64(2**64 - 1))
    key[:m] = (g >> U64(_POS) << U64(_POS)) | (np.arange(m, dtype=U64) & U64((1 << _POS) - 1))
    k = key.reshape(-1, w)
    up = np.minimum.accumulate(k, axis=1).ravel()
    down = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(down[: m - w + 1], up[w - 1 : m])
    start = np.arange(len(low))
    place = (low & U64((1 << _POS) - 1)).astype(np.int64)
    place += (start - place + (1 << _POS) - 1) >> _POS << _POS
    edge = np.zeros(n + 1, np.int8)
    long = np.diff(o) >= least
    np.add.at(edge, o[:-1][long], 1)
    np.add.at(edge, o[1:][long] - least + 1, -1)
    inside = np.cumsum(edge)[: len(low)] > 0
    new = np.ones(len(low), bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    new[o[1:-1][o[1:-1] < len(low)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    use = inside[first]
    first, last = first[use], last[use]
    return place[first], first, last, g[place[first]]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of the strings in a row, each closed by an end mark of its own, with text places at run ends.

    data: bytes of all strings, at: their offsets (one more than strings). Fewer than 2**21 bytes and end marks in all.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        size = np.diff(at)
        n = len(data) + len(size)
        if n >= 1 << _IX:
            raise ValueError("a block of the index is limited to 2**21 symbols")
        text = np.zeros(n, np.uint8)
        ends = np.cumsum(size + 1) - 1
        used = np.zeros(256, bool)
        used[data] = True
        symbol = np.cumsum(used).astype(np.uint8)  # UTF-8 leaves byte values unused, so 0 stays free for the end marks
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = symbol[data]
        self.text, self.n, self.ends, self.code = text, n, ends, np.where(used, symbol, 0)
        key = np.zeros(n, U64)
        width = 5
        for k in range(width):
            key <<= U64(8)
            key[: max(0, n - k)] |= text[k:]
        cut = np.zeros(n, bool)
        for k in range(width):
            near = ends - k
            cut[near[near >= 0]] = True
        for e in range(1, width):  # nothing after an end mark counts
            at_e = ends - e
            at_e = at_e[at_e >= 0]
            key[at_e] = key[at_e] >> U64(8 * (width - e)) << U64(8 * (width - e))
        key[ends] = 0
        rank, order, h = None, None, width
        mask = U64((1 << _IX) - 1)
        index = np.arange(n, dtype=U64)
        while True:
            packed = np.sort((key << U64(_IX)) | index)
            order = (packed & mask).astype(np.int64)
            value = packed >> U64(_IX)
            new = np.ones(n, bool)
            new[1:] = value[1:] != value[:-1]
            if rank is None:
                new |= cut[order]
                new[1:] |= cut[order[:-1]]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32) - 1
            if new.all():
                break
            key = rank.astype(U64) << U64(_IX)
            key[: n - h] |= rank[h:].astype(U64)
            h *= 2
        before = text[order - 1]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(head)
        self.run_symbols = before[heads]
        self.run_sizes = np.diff(np.append(heads, n))
        self.first_place = order[heads]
        self.last_place = order[np.append(heads[1:], n) - 1]
        self.border = self._common(self.first_place[1:], self.last_place[:-1])

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, which differ: eight bytes at a time, then the rest. A string's end mark differs from all."""
        text = np.concatenate([self.text, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(text, 8)
        ones, high = U64(0x0101010101010101), U64(0x8080808080808080)
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        while len(live):
            x = eight[i[live] + out[live]].view("<u8").ravel()
            y = eight[j[live] + out[live]].view("<u8").ravel()
            differ = x ^ y
            ended = (x - ones) & ~x & high  # the lowest set bit is that of the first end mark
            stop = differ | ended
            low = stop & (~stop + U64(1))
            done = stop != 0
            bit = np.log2(low[done].astype(np.float64)).astype(np.int64)  # a power of two is exact
            out[live[done]] += bit >> 3
            live = live[~done]
            out[live] += 8
        return out

    def matching(self) -> np.ndarray:
        """For every place the length of the longest match with another place, streamed over the text from the run ends' samples."""
        i, j = self.first_place[1:], self.last_place[:-1]
        reach = np.zeros(self.n, np.int64)
        reach[i] = i + self.border  # places are different within each list
        reach[j] = np.maximum(reach[j], j + self.border)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)


    def against(self, pattern: bytes) -> np.ndarray:
        """For every place of another text the length of its longest match in the indexed strings, streamed backwards over the runs.

        While the run at hand holds the next byte the match grows by a step of the transform; else it goes on from the nearest
        run of that byte on either side, of which the sampled places keep more of it.
        """
        heads = np.concatenate([[0], np.cumsum(self.run_sizes)[:-1]])
        total = np.bincount(self.run_symbols, self.run_sizes, 256).astype(np.int64)
        smaller = np.concatenate([[0], np.cumsum(total)[:-1]])
        runs, before = {}, np.zeros(len(heads), np.int64)
        for c in np.flatnonzero(total[1:]) + 1:
            runs[int(c)] = at = np.flatnonzero(self.run_symbols == c)
            before[at] = np.cumsum(self.run_sizes[at]) - self.run_sizes[at]
        out = np.zeros(len(pattern), np.int64)
        row = place = size = 0
        for i in range(len(pattern) - 1, -1, -1):
            c = int(self.code[pattern[i]])
            if c == 0:
                size = 0
                continue
            k = int(np.searchsorted(heads, row, "right")) - 1
            if not size or self.run_symbols[k] != c:
                j = int(np.searchsorted(runs[c], k))
                ways = [(int(r), end) for r, end in ((runs[c][j - 1] if j else -1, True), (runs[c][j] if j < len(runs[c]) else -1, False)) if r >= 0]
                found = []
                for r, end in ways:
                    to = int(self.last_place[r] if end else self.first_place[r])
                    same = size if not size or to == place else min(size, int(self._common(np.array([place]), np.array([to]))[0]))
                    found.append((same, r, int(heads[r] + self.run_sizes[r] - 1) if end else int(heads[r]), to))
                size, k, row, place = max(found)
            row, place, size = int(smaller[c] + before[k] + row - heads[k]), place - 1, size + 1
            out[i] = size
        return out


def _segments(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """f, g (128-bit digest of the segment and meta), meta (string starts << 32 | place of the fingerprint), doc_id, h (hash of the text), start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b, o = flat(part.column(1))
                place, first, last, f = owners(b, o, least, gram)
                row = np.searchsorted(o, first, "right") - 1
                size = last - first + least
                meta = ((last - first + 1) << 32) | (place - first)
                data = memoryview(np.ascontiguousarray(b))
                g = [hashlib.blake2b(data[s : s + k], digest_size=16, salt=m.to_bytes(8, "little")).digest() for s, k, m in zip(first.tolist(), size.tolist(), meta.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(g, pa.binary()), pa.array(meta), part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(first - o[row])], names=["f", "g", "meta", "doc_id", "h", "start"])

    return docs.mapInArrow(run, "f long, g binary, meta long, doc_id long, h long, start long")


def _bytes(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """f, g, meta, hot, data: the bytes of the wanted segments (f, g, meta, hot, doc_id, h, start), cut again from the texts."""
    by_doc = wanted.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("f", "g", "meta", "hot", "start")).alias("want"))
    rows = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h"))).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b, o = flat(part.column(0))
                want, w = part.column(1).flatten(), part.column(1).offsets.to_numpy()
                f, g, meta, hot, start = (want.field(k) for k in range(5))
                n = meta.to_numpy() >> 32
                start = start.to_numpy() + np.repeat(o[:-1], np.diff(w))
                data = [b[s : s + k + least - 1].tobytes() for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([f, g, meta, hot, pa.array(data, pa.binary())], names=["f", "g", "meta", "hot", "data"])

    return rows.mapInArrow(run, "f long, g binary, meta long, hot boolean, data binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of true flags."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _indexed(segments: DataFrame, least: int, block: int) -> DataFrame:
    """f, g, lo, hi: runs of string starts (hi is past the end) of the segments (f, g, data; different ones) that the index finds elsewhere too."""
    kind = segments.schema["f"].dataType.simpleString()

    def found(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        fs, gs, data = zip(*rows, strict=True)
        index = RunLengthIndex(np.frombuffer(b"".join(data), np.uint8), ragged(np.array([len(d) for d in data])))
        lo, hi = _runs(index.matching() >= least)
        which = np.searchsorted(index.ends, lo)
        base = np.concatenate([[0], index.ends[:-1] + 1])[which]
        return pa.RecordBatch.from_arrays([pa.array([fs[k] for k in which], of), pa.array([gs[k] for k in which], pa.binary()), pa.array(lo - base), pa.array(hi - base)], names=["f", "g", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = whole = cut = 0  # bytes held; of them, those of fingerprints that are complete, and their segments
        for batch in batches:
            of = batch.column(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and row[0] != held[-1][0]:
                    cut, whole = len(held), size
                    if size >= block // 2:
                        yield found(held, of)
                        held, size, cut, whole = [], 0, 0, 0
                held.append(row)
                size += len(row[2]) + 1
                if size >= 3 * block // 2 and cut:
                    yield found(held[:cut], of)
                    held, size, cut, whole = held[cut:], size - whole, 0, 0
        if held:
            yield found(held, of)

    return segments.select("f", "g", "data").repartition(4 * partitions(segments.sparkSession), "f").sortWithinPartitions("f", "g").mapInArrow(run, f"f {kind}, g binary, lo long, hi long")


def _pieces(hot: DataFrame, least: int, step: int) -> DataFrame:
    """k (digest of what the strings of a step have in common, the step, and f), d (digest of the piece), f, g, lo (first string start in the segment), n (string starts), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, g, meta, d in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                n, place = meta >> 32, meta & 0xFFFFFFFF
                rows = []
                for at in range((place - n + 1) // step, place // step + 1):  # distances from the fingerprint: at * step and on
                    lo, hi = max(0, place - at * step - step + 1), min(n - 1, place - at * step)
                    begin = place - at * step
                    common = d[begin : begin - step + 1 + least]
                    piece = d[lo : hi + least]
                    own = at.to_bytes(8, "little", signed=True) + f.to_bytes(8, "little", signed=True)
                    rows.append((hashlib.blake2b(common + own, digest_size=16).digest(), hashlib.blake2b(piece, digest_size=16, salt=(begin - lo).to_bytes(8, "little")).digest(), f, g, lo, hi - lo + 1, piece))
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k", "d", "f", "g", "lo", "n", "data"])

    return hot.select("f", "g", "meta", "data").mapInArrow(run, "k binary, d binary, f long, g binary, lo long, n long, data binary")


def _dealt_again(hot: DataFrame, least: int, block: int, most: int, step: int) -> DataFrame:
    """f, g, lo, hi for segments (f, g, meta, data) of fingerprints beyond an index."""
    pieces = scratch(_pieces(hot, least, step), "pieces")
    kinds = pieces.groupBy("k", "d").agg(F.count("*").alias("c"), F.first("data").alias("data"))
    kinds = scratch(kinds, "kinds")
    groups = kinds.groupBy("k").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("data") + 1).alias("size")).where("kinds > 1")
    mixed = scratch(kinds.join(groups, "k").select(F.col("k").alias("f"), F.col("d").alias("g"), "data", (F.col("size") > most).alias("hot")), "mixed")
    inside = _indexed(mixed.where("NOT hot"), least, block).unionByName(_counted(mixed.where("hot"), least))
    inside = scratch(inside.select(F.col("f").alias("k"), F.col("g").alias("d"), F.col("lo").alias("from"), F.col("hi").alias("to")), "inside")
    places = pieces.select("k", "d", "f", "g", "lo", "n")
    equal = places.join(kinds.where("c > 1").select("k", "d"), ["k", "d"], "left_semi").select("f", "g", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    return places.join(inside, ["k", "d"]).select("f", "g", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi")).unionByName(equal)


def _counted(segments: DataFrame, least: int) -> DataFrame:
    """The same as `_indexed`: every string is digested, and the digests are counted."""
    kind = segments.schema["f"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, g, d in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(d) - least + 1
                digests = [hashlib.blake2b(d[k : k + least], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([f.as_py()] * n, f.type), pa.array([g] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary())], names=["f", "g", "lo", "s"])

    rows = scratch(segments.select("f", "g", "data").mapInArrow(run, f"f {kind}, g binary, lo long, s binary"), "strings")
    many = rows.groupBy("s").count().where("count > 1").select("s")
    return rows.join(many, "s", "left_semi").select("f", "g", "lo", (F.col("lo") + 1).alias("hi"))


def dedup(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, most: int = MOST, step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans ("start-end," in bytes), kept_sha256, kept: one row for each row of `docs` (doc_id, text).

    kept holds the remaining bytes, which may end inside a character. Each byte covered by a string of `least` bytes that
    starts anywhere else in the corpus goes. Matches never cross documents. Null texts count as empty; an empty table gives
    an empty result; other columns of `docs` are left out. Rows that repeat a doc_id, or have none, are documents like others.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = scratch(_segments(docs, least, gram), "segments")
    alike = scratch(rows.groupBy("f", "g").agg(F.first("meta").alias("meta"), F.count("*").alias("c"), F.min(F.struct("doc_id", "h", "start")).alias("at")), "alike")
    size = (F.shiftright("meta", 32) + least).cast("long")
    by_f = alike.groupBy("f").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.sum(size + 1).alias("size")).where("total > 1")
    shared = scratch(alike.join(by_f, "f").select("f", "g", "meta", "c", "at", "kinds", (F.col("size") > most).alias("hot")), "shared")
    drop_scratch(docs.sparkSession, alike)
    wanted = shared.where("kinds > 1").select("f", "g", "meta", "hot", F.col("at.doc_id").alias("doc_id"), F.col("at.h").alias("h"), F.col("at.start").alias("start"))
    data = scratch(_bytes(docs, wanted, least).dropDuplicates(["f", "g"]), "bytes")
    marks = _indexed(data.where("NOT hot"), least, block).unionByName(_dealt_again(data.where("hot"), least, block, most, step))
    whole = shared.where("c > 1").select("f", "g", F.lit(0).cast("long").alias("lo"), F.shiftright("meta", 32).alias("hi"))
    marks = scratch(marks.join(whole.select("f", "g"), ["f", "g"], "left_anti").unionByName(whole), "marks")
    drop_scratch(docs.sparkSession, data, shared)
    spans = rows.join(marks, ["f", "g"]).select("doc_id", "h", (F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") - 1 + least).alias("e"))
    by_doc = spans.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        for batch in batches:
            for part in slices(batch, "text"):
                b, o = flat(part.column(1))
                at, ranges = part.column(2).offsets.to_numpy(), part.column(2).flatten()
                s, e = (ranges.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at = at - at[0]
                out = []
                for i in range(part.num_rows):
                    n = int(o[i + 1] - o[i])
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, s[at[i] : at[i + 1]], 1)
                    np.add.at(edge, e[at[i] : at[i + 1]], -1)
                    gone = np.cumsum(edge)[:n] > 0
                    lo, hi = _runs(gone)
                    kept = b[o[i] : o[i + 1]][~gone].tobytes()
                    out.append((n, n - len(kept), len(lo), "".join(f"{x}-{y}," for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept_sha256 string, kept binary")
