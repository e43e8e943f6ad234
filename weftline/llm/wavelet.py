"""Token ids in wavelet-matrix shard files.

A shard file holds the ids of a run of documents in ascending doc_id order as 16 bit planes, most significant first: each
plane has a bit for every token, and the tokens of the next plane are stably parted by it, zeros first. A count of ones
before every block of 512 bits gives rank in a look-up and one masked popcount, and select by bisection over the blocks.
Planes are compressed in groups of GROUP blocks, counts are stored as they are, and a header has the size of every group: a
`ShardFile` answers access, rank, select, count and occurrence from the file, reading a few bytes of counts and inflating
one group of 8 kB at a time.

Files are written under temporary names in the shared folder and renamed; only those in the committed manifest are read,
so a task that runs twice does no harm. A task writes one file for at most shard_tokens ids or one longer document.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions, scratch, scratch_path
from weftline.llm.kernels import slices
from weftline.llm.tokens import ENCODED_BYTES, encoder, vocabulary, with_end

MAGIC = b"WLWM0002"
BITS = 16
BLOCK = 512
GROUP = 128
HEAD = struct.Struct("<8sQQQ")  # magic, tokens, documents, bytes of the documents' section
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Planes:
    """What bit planes answer, from two things: the bytes of a block, and the ones before a block."""

    n: int
    zeros: list[int]

    def _block(self, level: int, block: int) -> np.ndarray:
        raise NotImplementedError

    def _before(self, level: int, block: int) -> int:
        raise NotImplementedError

    def bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK)[i % BLOCK >> 3]) >> (i & 7) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        if not i % BLOCK:
            return self._before(level, block)
        part = self._block(level, block)[: i % BLOCK + 7 >> 3]
        n = self._before(level, block) + int(_ONES[part].sum())
        return n - int(_ONES[int(part[-1]) >> (i & 7)]) if i & 7 and len(part) else n

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        out = 0
        for level in range(BITS):
            b, ones = self.bit(level, i), self.rank1(level, i)
            out = out << 1 | b
            i = self.zeros[level] + ones if b else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the tokens before place i that equal `token` lie at the end: start and end."""
        lo, hi = 0, i
        for level in range(BITS):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (BITS - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, i: int | None = None) -> int:
        """How often a token is among the first i (all)."""
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - level) & 1
            at = self.select(level, one, at - self.zeros[level] if one else at)
        return at


class WaveletMatrix(Planes):
    """Planes of packed bits (low bit first) in memory, with ones counted before every block."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.counts = n, zeros, planes, counts

    def _block(self, level: int, block: int) -> np.ndarray:
        return self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)]

    def _before(self, level: int, block: int) -> int:
        return int(self.counts[level][block])

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        x = np.ascontiguousarray(tokens, np.uint16)
        zeros, planes, counts = [], [], []
        for b in range(BITS - 1, -1, -1):
            bit = (x >> np.uint16(b)) & np.uint16(1) != 0
            plane = np.packbits(bit, bitorder="little")
            plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
            ones = _ONES[plane].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            counts.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            planes.append(plane)
            low, high = np.compress(~bit, x), np.compress(bit, x)
            zeros.append(len(low))
            x = np.concatenate([low, high])
        return cls(len(tokens), zeros, planes, counts)

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the last to the first."""
        x = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[level], np.empty(self.n, np.uint16)
            out[np.flatnonzero(~bit)] = x[:z]
            out[np.flatnonzero(bit)] = x[z:] | np.uint16(1 << (BITS - 1 - level))
            x = out
        return x


def dump(tokens: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, offsets: np.ndarray) -> bytes:
    """The bytes of a shard file: header, zeros of each plane, sizes of the groups, counts, the documents' section, groups."""
    m = WaveletMatrix.build(tokens)
    pack = zstandard.ZstdCompressor(level=1).compress
    docs = pack(doc_ids.astype("<i8").tobytes() + has_id.astype(np.uint8).tobytes() + offsets.astype("<i8").tobytes())
    step = GROUP * (BLOCK // 8)
    groups = [pack(p[k : k + step].tobytes()) for p in m.planes for k in range(0, len(p), step)]
    sizes = np.array([len(g) for g in groups], "<u4")
    return b"".join([HEAD.pack(MAGIC, len(tokens), len(doc_ids), len(docs)), np.array(m.zeros, "<i8").tobytes(), sizes.tobytes(), *(c.astype("<u4").tobytes() for c in m.counts), docs, *groups])


class ShardFile(Planes):
    """A shard file that is read where a question needs it; `source` is open and can be sought. Keeps the last groups that it inflated."""

    def __init__(self, source, kept: int = 64) -> None:
        self.source = source
        source.seek(0)
        magic, self.n, self.docs, docs_size = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self.zeros = np.frombuffer(source.read(8 * BITS), "<i8").tolist()
        self.blocks = -(-self.n // BLOCK)
        self.groups = -(-self.blocks // GROUP)
        sizes = np.frombuffer(source.read(4 * BITS * self.groups), "<u4").astype(np.int64)
        self.counts_at = HEAD.size + 8 * BITS + 4 * len(sizes)
        self.docs_at, self.docs_size = self.counts_at + 4 * BITS * (self.blocks + 1), docs_size
        self.at = self.docs_at + docs_size + np.concatenate([[0], np.cumsum(sizes)])
        self._group = lru_cache(maxsize=kept)(self._inflated)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(size))

    def _inflated(self, k: int) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(self.at[k], self.at[k + 1] - self.at[k])), np.uint8)

    def _block(self, level: int, block: int) -> np.ndarray:
        at = block % GROUP * (BLOCK // 8)
        return self._group(level * self.groups + block // GROUP)[at : at + BLOCK // 8]

    def _before(self, level: int, block: int) -> int:
        return struct.unpack("<I", self._read(self.counts_at + 4 * (level * (self.blocks + 1) + block), 4))[0]

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, which of them are not null, and the offset of each (one more)."""
        raw = zstandard.ZstdDecompressor().decompress(self._read(self.docs_at, self.docs_size))
        return np.frombuffer(raw, "<i8", self.docs), np.frombuffer(raw, np.uint8, self.docs, 8 * self.docs).astype(bool), np.frombuffer(raw, "<i8", self.docs + 1, 9 * self.docs)

    def matrix(self) -> WaveletMatrix:
        """All of it in memory."""
        counts = np.frombuffer(self._read(self.counts_at, 4 * BITS * (self.blocks + 1)), "<u4").reshape(BITS, -1)
        planes = [np.concatenate([np.zeros(0, np.uint8), *(self._inflated(level * self.groups + k) for k in range(self.groups))]) for level in range(BITS)]
        return WaveletMatrix(self.n, self.zeros, planes, list(counts))


def load(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, doc_ids, which of them are not null, and document offsets of a shard file."""
    file = ShardFile(io.BytesIO(data))
    return file.matrix(), *file.documents()


def lookup(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, file, count, first: how often each token is in each shard, and its first place there (null if it is in none), from the files' planes; no shard is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = pa.fs.FileSystem.from_uri(name)
                with fs.open_input_file(root) as source:
                    shard = ShardFile(source)
                    found = [(t, name, n := shard.count(t), shard.occurrence(t, 0) if n else None) for t in tokens]
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["token", "file", "count", "first"])

    return manifest.select("file").mapInArrow(run, "token int, file string, count long, first long")


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, shard_tokens: int = 4_000_000) -> DataFrame:
    """Writes shards of `docs` (doc_id, text) in ascending doc_id order; returns the manifest: task, shard (both ascending with doc_id), file, docs, tokens.

    Null doc_ids come first. Null and empty texts are the end id alone.
    """
    name = tokenizer or vocabulary("word_bpe_49k.json")
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(4 * partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        done: list[tuple[int, int, str, int, int]] = []
        size, task = 0, 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            tokens = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([np.diff(h[1]) for h in held])
            ids = pa.concat_arrays([h[2] for h in held])
            file = f"shard-{task:06d}-{len(done):06d}-{uuid.uuid4().hex}.wm"
            with fs.open_output_stream(f"{root}/.{file}.tmp", compression=None) as out:
                out.write(dump(tokens, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])))
            fs.move(f"{root}/.{file}.tmp", f"{root}/{file}")
            done.append((task, len(done), f"{path}/{file}", len(lengths), len(tokens)))
            held, size = [], 0

        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                task = part.column(2)[0].as_py()
                ids, at = with_end(*encode(part.column(1)))
                held.append((ids.astype(np.uint16), at, part.column(0).cast(pa.int64())))
                size += len(ids)
                if size >= shard_tokens:
                    flush()
        flush()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=["task", "shard", "file", "docs", "tokens"])

    return ordered.mapInArrow(run, "task int, shard int, file string, docs long, tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files of a manifest."""
    files = manifest.count()
    before = F.sum("tokens").over(Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    placed = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = pa.fs.FileSystem.from_uri(file)
                with fs.open_input_stream(root, compression=None) as src:
                    matrix, ids, has, at = load(src.read())
                data = memoryview(matrix.tokens().astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~has), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, min(files, 100_000))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """The documents' tokens written to shards and read back; one row for each row of `docs`. An empty table gives an empty result."""
    manifest = scratch(write(docs, scratch_path(docs.sparkSession, "wavelet"), tokenizer=tokenizer), "manifest")
    return read(manifest)
