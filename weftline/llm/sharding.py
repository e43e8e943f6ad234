"""Balanced label propagation: documents of equal text move to a common shard while all shards keep their sizes.

Links are never expanded into pairs: what a document sees of its group is a count for each shard. Labels start as runs of
whole groups: groups beyond a quota (fewer than n) get shards of their own and share the last, the others lie in a row
that is cut into shares of the quotas, and a group that a cut divides goes whole to a shard with room for it. Then, in a
round, every document asks for the shard that holds most of its group; pairs of shards exchange equal numbers of askers,
full ones too, and a shard with room takes more up to its quota. In every other round only shards with room are asked for.
A move raises the sum of the squared counts of a group by shard, so rounds end, and they go on until nothing moves.
Documents without links are dealt last and fill every shard to its exact count. What reaches the driver is n rows of
shards and of groups, and n*n flows. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import partitions, rank_within, scratch


def _values(spark: SparkSession, names: str, rows: list[tuple[int, ...]]) -> DataFrame:
    kinds = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names.split(", "))
    return spark.sql(f"SELECT {kinds} FROM VALUES {', '.join(str(tuple(map(int, r))) for r in rows)} AS t({names})")


def _exchange(wanted: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, int]]:
    """(shard, target, moves): equal numbers both ways, and what fits the target's room, shared out by demand."""
    out = {k: min(w, wanted.get((k[1], k[0]), 0)) for k, w in wanted.items()}
    for t in range(len(room)):
        left = {k: w - out[k] for k, w in wanted.items() if k[1] == t and w > out[k]}
        total, free = sum(left.values()), room[t]
        for k, w in sorted(left.items()):
            give = min(w, -(-room[t] * w // total), free)
            out[k] += give
            free -= give
    return [(s, t, m) for (s, t), m in out.items() if m]


def _piece_list(size: int, free: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, shard) for a group of that size: the tightest shard that takes the rest, or all of the one with most room."""
    out, at = [], 0
    while at < size:
        fit = [s for s in range(len(free)) if free[s] >= size - at]
        s = min(fit, key=free.__getitem__) if fit else max(range(len(free)), key=free.__getitem__)
        take = min(free[s], size - at)
        out.append((at, at + take, s))
        free[s] -= take
        at += take
    return out


def _reunite(divided: list[tuple[bytes, int, int]], ends: list[int], room: list[int]) -> dict[bytes, int]:
    """The shard for each divided group (gid, start, size) that some shard has room for; `room` is kept up to date."""
    out: dict[bytes, int] = {}
    found = True
    while found:
        found = False
        for gid, start, size in sorted(divided, key=lambda d: (d[2], d[0])):
            lows = [0, *ends[:-1]]
            part = [max(0, min(e, start + size) - max(low, start)) for low, e in zip(lows, ends, strict=True)]
            fit = [s for s in range(len(ends)) if room[s] + part[s] >= size]
            if gid in out or not fit:
                continue
            to = out[gid] = max(fit, key=lambda s: (part[s], -room[s]))
            for s, c in enumerate(part):
                room[s] += c
            room[to] -= size
            found = True
    return out


def _below(ends: list[int], at: Column) -> Column:
    """How many of `ends` are at most `at`."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= at)).cast("long")


def _labelled(linked: DataFrame, groups: DataFrame, quota: list[int], buckets: int) -> DataFrame:
    """linked (doc_id, size, text_crc32, gid) with its first `shard`; groups: gid, g (rows of it)."""
    spark, n, free = linked.sparkSession, len(quota), list(quota)
    pieces = []
    large = groups.where(F.col("g") > min(quota)).collect()
    for r in sorted(large, key=lambda r: (-r["g"], bytes(r["gid"]))):
        pieces += [(bytes(r["gid"]), *p) for p in _piece_list(r["g"], free)]
    small = groups.where(F.col("g") <= min(quota)).withColumn("b", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    sums = small.groupBy("b").agg(F.sum("g").alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inner = F.sum("g").over(Window.partitionBy("b").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch(small.withColumn("inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(before), "b").select("gid", "g", (F.col("off") + F.col("inner")).alias("start")), "starts")
    total, space = starts.agg(F.sum("g")).first()[0] or 0, sum(free)
    ends = [total * sum(free[: s + 1]) // max(1, space) for s in range(n)]
    room = [f - (e - low) for f, e, low in zip(free, ends, [0, *ends[:-1]], strict=True)]
    divided = starts.where(_below(ends, F.col("start")) < _below(ends, F.col("start") + F.col("g") - 1)).collect()
    whole = _reunite([(bytes(r["gid"]), r["start"], r["g"]) for r in divided], ends, room)
    pieces += [(bytes(r["gid"]), 0, r["g"], whole[bytes(r["gid"])]) for r in divided if bytes(r["gid"]) in whole]
    rows = ", ".join(f"(X'{gid.hex()}', {low}L, {high}L, {s}L)" for gid, low, high, s in pieces or [(b"", 0, 0, 0)])
    planned = spark.sql(f"SELECT * FROM VALUES {rows} AS t(pg, low, high, to)")
    ranked = rank_within(linked, ["gid"], ["doc_id", "size"], "r", buckets).join(starts.select("gid", "start"), "gid", "left")
    fits = (F.col("gid") == F.col("pg")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high"))
    placed = F.coalesce("to", _below(ends, F.col("start") + F.col("r")))
    return scratch(ranked.join(F.broadcast(planned), fits, "left").select("doc_id", "size", "text_crc32", "gid", placed.alias("shard")), "linked")


def propagate(linked: DataFrame, quota: list[int], buckets: int) -> DataFrame:
    """linked (doc_id, size, text_crc32, gid, shard) after rounds of propagation until neither kind of round moves a row."""
    spark, n = linked.sparkSession, len(quota)
    order, idle, any_ = ["gid", "doc_id", "size"], 0, True
    while idle < 2:
        held = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
        room = [max(0, quota[s] - held.get(s, 0)) for s in range(n)]
        count = linked.groupBy("gid", "shard").agg(F.count("*").alias("c")).withColumn("tie", F.xxhash64("gid", "shard"))
        open_ = F.get(F.array(*map(F.lit, room)), F.col("shard").cast("int")) > 0
        best = (count if any_ else count.where(open_)).groupBy("gid").agg(F.max(F.struct("c", "tie", F.col("shard").alias("target"))).alias("b"))
        moves = count.join(best, "gid").where("b.target <> shard AND (b.c > c OR b.c = c AND b.tie > tie)").select("gid", "shard", F.col("b.target").alias("target"))
        asked = scratch(linked.join(moves, ["gid", "shard"], "left"), "asked")
        wanted = {(r["shard"], r["target"]): r["count"] for r in asked.where("target IS NOT NULL").groupBy("shard", "target").count().collect()}
        if any_ and not wanted:
            break
        any_ = not any_
        flows = _exchange(wanted, room)
        idle = 0 if flows else idle + 1
        if not flows:
            continue
        ranked = rank_within(asked.where("target IS NOT NULL"), ["shard", "target"], order, "r", buckets)
        ranked = ranked.join(F.broadcast(_values(spark, "shard, target, moves", flows)), ["shard", "target"], "left")
        moved = ranked.withColumn("shard", F.when(F.col("r") < F.coalesce("moves", F.lit(0)), F.col("target")).otherwise(F.col("shard")))
        columns = ["doc_id", "size", "text_crc32", "gid", "shard"]
        linked = scratch(asked.where("target IS NULL").select(*columns).unionByName(moved.select(*columns)), "linked")
    return linked


def shard(docs: DataFrame, *, n: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), one row for each row of `docs`.

    Shard counts differ by one at most. A null text has size 16, the crc of no bytes, and no links; empty texts are one
    group. Null doc_ids and repeated rows are placed like others. A group beyond a shard's quota takes whole
    shards and the tightest place that is left for the rest. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch(docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("gid")), "rows")
    total = rows.count()
    groups = scratch(rows.where("gid IS NOT NULL").groupBy("gid").agg(F.count("*").alias("g")).where("g > 1"), "groups")
    tagged = scratch(rows.join(groups.select("gid", F.lit(True).alias("linked")), "gid", "left"), "tagged")
    quota = [total // n + (s < total % n) for s in range(n)]
    linked = propagate(_labelled(tagged.where("linked").drop("linked"), groups, quota, buckets), quota, buckets)
    held = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
    fullest = sorted(range(n), key=lambda s: -held.get(s, 0))
    quota = {s: total // n + (k < total % n) for k, s in enumerate(fullest)}
    ends, at = [], 0
    for s in range(n):
        at += quota[s] - held.get(s, 0)
        ends.append(at)
    free = rank_within(tagged.where("linked IS NULL"), [], ["doc_id", "text_crc32", "size"], "r", buckets)
    placed = free.select("doc_id", "size", "text_crc32", _below(ends, F.col("r")).alias("shard")).unionByName(linked.select("doc_id", "size", "text_crc32", "shard"))
    out = rank_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
