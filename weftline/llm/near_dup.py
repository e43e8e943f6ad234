"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds its distinct shingles; the sketch keeps the k smallest hashes (the whole set if that is smaller).
Copies (equal sets) are one class from the start, and all that follows works on classes.

Of two sets of n and m shingles that are similar, c = threshold / (1 + threshold) * (n + m) values or more are common, and
those below both sketches' largest values are in both sketches. A set of at most k values is its own sketch, so all c count;
of a larger one the k smallest hold k * c / n of them on average, and the bound is put five standard deviations below that.
The smaller of the two sides' bounds is the overlap that the sketches must have.

Retained values are counted over all classes, exactly, and ordered by that count, rarest first. A pair with the required
overlap meets in the inverted list of one of the (size - overlap + 1) rarest values of either side, and what follows a value in
either sketch bounds the overlap of pairs that meet there. Values that only one class holds come first and are in no list, so
a class with many of its own words has few places left, and lists stay short.

Lists are first compared with one pivot, the member with the fewest rarer values, which is the original of a family of edited
copies if it is there. Lists that still span several components yield their remaining pairs between components, once each: a
pair that has met in one of the NEAR preceding values of both is left to that list.

Candidates pass three filters, each on more bytes: signatures of one bit for each of SIGNS ranges of hash values (the lowest bit
of the least value in the range), union sketches, and 16 bits of each value. Full sets confirm every link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, drop_scratch, partitions, scratch
from weftline.llm.kernels import flat, list_array, ragged, ranges, shingle_sets, slices

K = 256
#: Preceding values of a posting by which a pair is known to have met before.
NEAR = 6
SIGNS = 1024
#: Bits of the table that picks the documents whose sets are made again, at most (16 MB); others are left out by a join.
MARKS = 1 << 27


def _sets(width: int, text: str = "text"):
    def each(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        at = batch.schema.get_field_index(text)
        for part in slices(batch, text):
            b, o = flat(part.column(at))
            yield part, list(shingle_sets(b, o, width))

    return each


def _ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def least_overlap(k: int, threshold: float) -> int:
    """Values of a similar set's share at the threshold among k of a larger one, five deviations down."""
    return max(1, math.floor(threshold * k - 5 * math.sqrt(k * threshold * (1 - threshold))))


def required(n: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Overlap that the sketches of a similar pair have, given the size of either set."""
    whole, t = np.ceil(threshold * n - 1e-9), least_overlap(k, threshold)
    return np.where(n <= threshold * k, whole, np.where(n <= k, np.minimum(whole, t), t)).astype(np.int64)


def _wanted(n: Column, m: Column, k: int, percent: int) -> Column:
    """Overlap that the sketches of a similar pair have, given both sizes."""
    common = F.floor((percent * (n + m) + 99 + percent) / (100 + percent))

    def side(size: Column) -> Column:
        q = F.least(F.lit(1.0), common / size)
        return F.when(size <= k, common).otherwise(F.floor(k * q - 5 * F.sqrt(k * q * (1 - q))))

    return F.greatest(F.lit(1), F.least(side(n), side(m)))


def _may_link(k: int, percent: int) -> Column:
    """Whether two postings (n, p of one, m, q of the other) of one value may be the rarest shared one of a link."""
    n, m, p, q = F.col("n"), F.col("m"), F.col("p"), F.col("q")
    room = F.least(F.least(n, F.lit(k)) - p, F.least(m, F.lit(k)) - q)
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (room >= _wanted(n, m, k, percent))


def _base(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n, cid (class of equal sets; null for an empty one), sketch (k smallest hashes, ascending)."""
    sets = _sets(width)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in sets(batch):
                n = np.array([len(s) for s in found], np.int64)
                v = np.concatenate([s[:k] for s in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _ids(found), list_array(ragged(np.minimum(n, k)), pa.array(v.view(np.int64)))], names=["doc_id", "n", "cid", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, cid binary, sketch array<long>")


def _postings(classes: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """value, id, n, p (values before it in the class's order), prev (the last NEAR of those that others hold): the rarest retained values of each class. Also the scratch table of counts."""
    held = classes.select("id", F.col("n").cast("int").alias("n"), F.explode("sketch").alias("value"))
    counts = scratch(held.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    known = held.join(counts, "value").select("id", "n", "c", "value").repartition(partitions(classes.sparkSession), "id").sortWithinPartitions("id", "c", "value")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows in runs of whole classes."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            ids = rows["id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            rest = rows.slice(cut)
            if cut:
                yield rows.slice(0, cut)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches):
            ids, n, value = rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["value"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            count = np.diff(np.append(starts, len(ids)))
            size = np.minimum(n[starts], k)
            own = size - count  # values that no other class holds
            take = np.clip(size - required(n[starts], k, percent / 100) + 1 - own, 0, count)
            at, place = ranges(starts, take), ranges(np.zeros(len(take), np.int64), take)
            before = np.minimum(place, NEAR)
            prev = list_array(ragged(before), pa.array(value[ranges(at - before, before)]))
            yield pa.RecordBatch.from_arrays([pa.array(value[at]), pa.array(ids[at]), pa.array(n[at]), pa.array(place + np.repeat(own, take)), prev], names=["value", "id", "n", "p", "prev"])

    return known.mapInArrow(run, "value long, id long, n long, p long, prev array<long>"), counts


def _full(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """id, full (the set's hashes, ascending), bits (16 bits of each), sign for need (id, cid, rep: a doc_id of that class).

    Sets are made again where the texts are read, for the documents that a bit table does not rule out.
    """
    spark = docs.sparkSession
    size = min(MARKS, 1 << max(16, (16 * need.count()).bit_length()))
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    words = need.select(mark("rep").alias("m")).groupBy(F.expr("m div 32").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, m % 32))").alias("bits")).toArrow()
    table = np.zeros(size // 32, np.uint32)
    table[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)
    sets = _sets(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_numpy()
            for _, found in sets(batch.filter(pa.array((shared.value[m // 32] >> (m % 32).astype(np.uint32) & 1).astype(bool)))):
                yield pa.RecordBatch.from_arrays([_ids(found), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([(s >> np.uint64(48)).astype("<u2").tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in signatures(found)], pa.binary())], names=["cid", "full", "bits", "sign"])

    again = docs.select(mark("doc_id").alias("m"), "text").mapInArrow(run, "cid binary, full binary, bits binary, sign binary")
    return again.join(need.select("cid", "id"), "cid").dropDuplicates(["cid"]).select("id", "full", "bits", "sign")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SIGNS bits, packed, for each ascending set."""
    out = np.zeros((len(sets), SIGNS), bool)
    v = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    part = (v >> np.uint64(64 - SIGNS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(v), bool)
    first[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    first &= (v & np.uint64(1)).astype(bool)
    out[row[first], part[first]] = True
    return np.packbits(out, axis=1)


def most_differing(threshold: float) -> int:
    """Bits in which signatures of that similarity differ, six deviations up (a chance of 1e-9): 160 for 0.8. A differing value changes one bit at most, so unions of up to 800 values are safe at 0.8."""
    q = (1 - threshold) / 2
    return min(SIGNS, math.floor(SIGNS * q + 6 * math.sqrt(SIGNS * q * (1 - q))))


def estimate(x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, int]:
    """Similarity by the union's k smallest values, of ascending arrays, and how many values that rests on."""
    z = np.sort(np.concatenate([x[:k], y[:k]]))
    twice = np.zeros(len(z), bool)
    twice[1:] = z[1:] == z[:-1]
    union = z[~twice]
    size = min(k, len(union))
    return float((z[twice] <= union[size - 1]).sum()) / size, size


def _links(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: first those whose signatures are close, then those that pass the union sketch (five deviations of slack) and the 16-bit sets, whose similarity is never below the true one, then those whose full sets are."""
    threshold = percent / 100

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIGNS // 8) for c in batch.columns[2:])
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(differ <= most_differing(threshold)))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(p.as_buffer(), "<u2"), np.frombuffer(q.as_buffer(), "<u2")
                guess, size = estimate(x, y, k)
                if guess < threshold - 5 * math.sqrt(threshold * (1 - threshold) / size) - 4 / size:
                    keep.append(False)
                    continue
                u, cu = np.unique(x, return_counts=True)
                v, cv = np.unique(y, return_counts=True)
                _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                same = int(np.minimum(cu[i], cv[j]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                z = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]))
                same = int((z[1:] == z[:-1]).sum())
                keep.append(100 * same >= percent * (len(z) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(pairs: DataFrame, what: str) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col(what).alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col(what).alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    near = scratch(both(pairs.select("a", "b"), "sign").mapInArrow(close, "a long, b long"), "close")
    few = scratch(both(near, "bits").mapInArrow(likely, "a long, b long"), "likely")
    out = scratch(both(few, "full").mapInArrow(exact, "a long, b long"), "links")
    drop_scratch(pairs.sparkSession, near, few)
    return out


def near_dups(docs: DataFrame, *, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of `docs` (columns doc_id, of any type that can be ordered, and text; others are ignored).

    Links hold where 100 * intersection >= percent * union; component_id is the smallest doc_id reachable over links.
    Null or empty texts, and texts of separators only, have an empty set and are linked with nothing. A text of fewer than
    `width` words is one shingle. Repeated rows are copies of each other. Rows with a null doc_id take part; where a
    component has no other doc_id, its id is null. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    base = scratch(_base(docs, width, k), "sketches")
    rows = scratch(base.select("doc_id", "n", "cid"), "rows")
    equal = base.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch(equal.withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = scratch(classes.select("id", "cid", "rep"), "reps")
    drop_scratch(spark, base)
    post, counts = _postings(classes, k, percent)
    post = scratch(post, "postings")
    drop_scratch(spark, classes, counts)
    held = post.select("value", "id")
    lists = held.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("value")
    need = scratch(reps.join(held.join(lists, "value", "left_semi").select("id").distinct(), "id", "left_semi"), "need")
    sets = scratch(_full(docs, need, width), "sets")

    centre = F.min(F.struct((F.col("p") / F.least("n", F.lit(k))).alias("r"), F.xxhash64("id").alias("h"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("p").alias("q")))
    pivots = scratch(post.groupBy("value").agg(centre.alias("c")).select("value", "c.a", "c.m", "c.q"), "pivots")
    met = post.join(pivots, "value").where((F.col("a") != F.col("id")) & _may_link(k, percent)).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    met = scratch(met.distinct(), "met")
    links = _links(met, sets, k, percent)
    comps = components(links)

    labels = comps.select(F.col("node").alias("id"), "comp")
    mixed = held.join(labels, "id", "left").select("value", F.coalesce("comp", "id").alias("comp")).groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value")
    open_ = scratch(post.join(mixed, "value", "left_semi").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "open")
    other = open_.select("value", F.col("id").alias("a"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("comp").alias("ca"), F.col("prev").alias("before"))
    pairs = open_.join(other, (open_.value == other.value) & (F.col("ca") < F.col("comp")) & _may_link(k, percent) & ~F.arrays_overlap("prev", "before"))
    pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    pairs = scratch(pairs, "pairs")
    drop_scratch(spark, post, pivots, open_)
    found = _links(pairs, sets, k, percent)
    if not found.isEmpty():
        comps = components(links.union(found))
    drop_scratch(spark, sets, met, pairs)

    named = scratch(reps.join(comps.withColumnRenamed("node", "id"), "id", "left").select("cid", "rep", F.coalesce("comp", "id").alias("comp")), "named")
    ids = scratch(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "ids")
    by_class = named.join(ids, "comp").select("cid", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(by_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` with the least doc_id of each component, with all their columns; see `near_dups`.

    A row is named by doc_id and text together, so rows without a doc_id, or of one doc_id and different texts, are documents
    of their own; null doc_ids come last. Of rows that agree in both one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("t"))
    kept = near_dups(docs.select(key.alias("doc_id"), "text"), **how).where("kept").select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
