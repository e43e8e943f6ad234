"""WARC archives as a chunked record table.

Payloads travel as rows of (record, chunk number, at most CHUNK bytes) both ways: they are cut where the pages are read, with
digests that run over the chunks, and only chunk rows are shuffled. Which records are revisits is decided on digests alone;
a decision is a row of its own that sorts before the chunks of its record. The writer compresses chunk after chunk into
gzip members, a record each; the reader inflates a file in blocks and emits a row for each chunk, with running SHA-1 and
byte count. Beyond the value that the table of pages itself holds, no step has a payload whole. Files are written under a
temporary name and renamed, and only files in the committed manifest count, so a task that is run again leaves no second
copy. Equal payloads of MIN_REVISIT bytes or more are stored once; the other records are revisits that point to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import scratch, scratch_path

CHUNK = 1 << 18
MIN_REVISIT = 1000
FILE_BYTES = 128 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


PARTS = "page_id long, url string, digest string, payload_bytes long, part int, row long, chunk_no int, chunk binary"
#: Rows without a page_id may be many of one digest; they are dealt to so many places.
SALTS = 64


def _chunks(payload: memoryview) -> Iterator[memoryview]:
    for at in range(0, max(1, len(payload)), CHUNK):
        yield payload[at : at + CHUNK]


def _digest(payload: memoryview) -> str:
    sha = hashlib.sha1()
    for chunk in _chunks(payload):
        sha.update(chunk)
    return sha.hexdigest()


def _payload(value: pa.StringScalar) -> memoryview:
    return memoryview(value.as_buffer() if value.is_valid else b"").cast("B")


def digests(pages: DataFrame) -> DataFrame:
    """page_id, digest, payload_bytes of every row of `pages` (page_id, html); null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_digest(p), len(p)) for p in map(_payload, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["page_id", "digest", "payload_bytes"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, digest string, payload_bytes long")


def chunk_table(pages: DataFrame) -> DataFrame:
    """PARTS: a row for each chunk of each row of `pages`; (part, row) is a number of the row, the same whenever it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in PARTS.split(", ")]
        part, row, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = _payload(html)
                digest = _digest(payload)
                for no, chunk in enumerate(_chunks(payload)):
                    held.append((page_id, url, digest, len(payload), part, row, no, bytes(chunk)))
                    size += len(chunk)
                    if size >= 8 * CHUNK or len(held) >= 2000:
                        yield flush()
                        held, size = [], 0
                row += 1
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, PARTS)


def planned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The chunks of all records, each record's together and in order, after a row without a chunk (chunk_no -1) that names the response where it is to be a revisit (refers_to).

    Of equal payloads of at least min_revisit bytes the row with the largest page_id is the response; rows that repeat it
    are responses too. Null html is an empty payload. Where a group has null page_ids only, all are responses.
    """
    found = digests(pages)
    heads = found.where(F.col("payload_bytes") >= min_revisit).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1 AND top IS NOT NULL").select("d", "top")
    told = found.distinct().join(heads, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("top")))
    salts = F.when(F.col("page_id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    told = told.select("page_id", "digest", F.col("top").alias("refers_to"), F.explode(salts).alias("salt"), F.lit(-1).alias("chunk_no"))
    chunks = chunk_table(pages).withColumn("salt", F.when(F.col("page_id").isNull(), F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    both = chunks.unionByName(told, allowMissingColumns=True)
    return both.repartition("page_id", "digest", "salt").sortWithinPartitions("page_id", "digest", "salt", F.col("part").asc_nulls_first(), "row", "chunk_no").drop("part", "row", "salt")


def _line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _heads(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response"]
    lines += [f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write(records: DataFrame, path: str, *, level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows of planned() to .warc.gz files under path (any file system URI that pyarrow knows); returns the manifest: file, records."""
    chunks = records.select("page_id", "url", "payload_bytes", "digest", "refers_to", "chunk_no", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        done, out, name, packer, records_in, written = [], None, "", None, 0, 0
        told: tuple | None = None  # the last decision: page_id, digest, refers_to
        to: int | None = None
        try:
            for batch in batches:
                for page_id, url, size, digest, refers_to, chunk_no, chunk in zip(*(c if i == 6 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
                    if chunk_no < 0:
                        told = (page_id, digest, refers_to)
                        continue
                    if chunk_no == 0:
                        to = told[2] if told is not None and told[:2] == (page_id, digest) else None
                        if packer is not None:
                            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        if out is None or written >= file_bytes:
                            if out is not None:
                                out.close()
                                done.append((name, records_in))
                            name, records_in, written = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                            out = fs.open_output_stream(f"{root}/.{name}.tmp", compression=None)
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        out.write(packer.compress(_heads(page_id, url, size, digest, to)))
                        records_in += 1
                    if to is not None:
                        continue
                    data = packer.compress(chunk.as_buffer())
                    written += len(data) + 200
                    out.write(data)
            if out is not None:
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                done.append((name, records_in))
        finally:
            if out is not None:
                out.close()
        for name, _ in done:
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["file", "records"])

    return chunks.mapInArrow(run, "file string, records long")


class Inflated:
    """Reads a file of gzip members in blocks."""

    def __init__(self, stream, block: int = 1 << 18) -> None:
        self.stream, self.block, self.rest, self.data, self.at = stream, block, b"", b"", 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            raw = self.rest or self.stream.read(self.block)
            if not raw:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(raw, self.block)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                self.data, self.at = self.data[self.at :] + data, 0
                return True

    def line(self) -> bytes | None:
        while (end := self.data.find(b"\r\n", self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.data[self.at : end], end + 2
        return out

    def take(self, most: int) -> bytes:
        """1 to `most` bytes."""
        if self.at == len(self.data) and not self._more():
            raise ValueError("archive ends inside a record")
        out = self.data[self.at : self.at + most]
        self.at += len(out)
        return out


def _headers(src: Inflated) -> dict[str, str] | None:
    first = src.line()
    while first == b"":
        first = src.line()
    if first is None:
        return None
    found = {"": first.decode()}
    while line := src.line():
        k, _, v = line.decode().partition(":")
        found[k.lower()] = v.strip()
    return found


def records(stream) -> Iterator[tuple[dict[str, str], Iterator[bytes], dict[str, object]]]:
    """For each record its headers, its payload in pieces (to be read before the next record), and its running digest and size."""
    src = Inflated(stream)
    while (head := _headers(src)) is not None:
        left = int(head["content-length"])
        sha = hashlib.sha1()
        state: dict[str, object] = {"bytes": 0, "digest": ""}
        mark = 0
        http: dict[str, str] = {}
        while line := src.line():
            mark += len(line) + 2
            k, _, v = line.decode().partition(":")
            http[k.lower()] = v.strip()
        left -= mark + 2

        def pieces(left: int = left, state: dict = state, sha=sha) -> Iterator[bytes]:
            while left:
                piece = src.take(min(left, CHUNK))
                left -= len(piece)
                sha.update(piece)
                state["bytes"] += len(piece)
                yield piece
            state["digest"] = sha.hexdigest()

        state["http"] = http
        yield head, pieces(), state


SCHEMA = "page_id long, record_type string, refers_to long, file string, record_no long, chunk_no int, chunk binary, last boolean, payload_bytes long, payload_digest string"


def read(manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives in `manifest` (file): a row for each chunk, the digest and size on a record's last.

    A payload that differs from its record's digest raises. A revisit has one row without bytes, with size and digest of
    the payload that it refers to.
    """
    page = re.compile(r"<urn:page:(-?\d+)>")

    def number(uri: str | None) -> int | None:
        return int(m[1]) if uri and (m := page.fullmatch(uri)) else None

    def rows(file: str) -> Iterator[tuple]:
        fs, path = pa.fs.FileSystem.from_uri(file)
        with fs.open_input_stream(path, compression=None) as stream:
            for k, (head, pieces, state) in enumerate(records(stream)):
                want = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                own = (number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")), file, k)
                held, no = None, 0
                for piece in pieces:
                    if held is not None:
                        yield (*own, no, held, False, None, None)
                        no += 1
                    held = piece
                size = state["bytes"]
                if head["warc-type"] == "revisit":
                    size = int(state["http"]["content-length"])
                elif state["digest"] != want:
                    raise ValueError(f"{file}: record {k} does not have its digest")
                yield (*own, no, held, True, size, want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                part, size = [], 0
                for row in rows(file):
                    part.append(row)
                    size += len(row[6] or b"")
                    if size >= 8 * CHUNK or len(part) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    files = manifest.select("file")
    return files.repartition(max(1, min(files.count(), 100_000))).mapInArrow(run, SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what the archives of `pages` say when read back."""
    manifest = scratch(write(planned(pages), scratch_path(spark, "warc")), "manifest")
    return read(manifest).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
