"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a row belongs to the next point
clockwise of its own hash. A shard that has reached its bound is passed over, so
the overflow goes on clockwise. Only counts per arc of the ring are needed to
know where each arc's rows go; rows never leave their place for that."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import written

VNODES = 128
#: Position of rows inside an arc is counted in this many parts, so that an arc in which one key has most rows is shared out.
PARTS = 256


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place on the ring of 2**31, shard) in ring order."""
    ring = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") >> 1
            ring.setdefault(at, s)
    return sorted(ring.items())


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """Rows a shard takes at most. Without slack the bounds add up to the total
    and differ by one at most."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * total / shards)] * shards


def assign(loads: dict[int, int], ring: list[tuple[int, int]], caps: list[int]) -> list[dict]:
    """Segments (arc, lo, hi, shard, slot): rows ``lo`` to ``hi`` of an arc go to
    the shard and get slots from ``slot`` on. Arcs are served clockwise; there
    are at most as many segments as arcs and shards together, per full turn."""
    free, used, out = list(caps), [0] * len(caps), []
    for arc in range(len(ring)):
        lo, left, at = 0, loads.get(arc, 0), arc
        while left:
            shard = ring[at % len(ring)][1]
            take = min(left, free[shard])
            if take:
                out.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": shard, "slot": used[shard]})
                free[shard] -= take
                used[shard] += take
                lo, left = lo + take, left - take
            at += 1
    return out


def arc_of(place: Column, ring: list[tuple[int, int]]) -> Column:
    """Index of the first point at or after ``place``, by a table of the ring."""
    text = json.dumps([at for at, _ in ring])
    table = F.from_json(F.lit(text), "array<int>")
    low = F.aggregate(F.sequence(F.lit(0), F.lit(len(ring).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(ring)).alias("b")),
                      lambda acc, _: F.when(acc["a"] >= acc["b"], acc).otherwise(
                          F.when(F.get(table, ((acc["a"] + acc["b"]) / 2).cast("int")) < place, F.struct((((acc["a"] + acc["b"]) / 2).cast("int") + 1).alias("a"), acc["b"].alias("b")))
                          .otherwise(F.struct(acc["a"].alias("a"), ((acc["a"] + acc["b"]) / 2).cast("int").alias("b")))), lambda acc: acc["a"])
    return F.pmod(low, F.lit(len(ring)))


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row.

    A row's place on the ring is a hash of doc_id and text. ``slack`` is how
    much more than the mean a shard may hold; with 0 the counts of all shards
    differ by one at most. ``slot`` numbers a shard's rows from 0 without gaps.
    A null text has size 1 and the checksum of no bytes; null doc_ids hash like
    a value. Repeated rows share a place and are spread clockwise when it is
    full. An empty table gives no rows.

    What reaches the driver is one count per arc (``shards * vnodes`` at most),
    whatever the input."""
    spark = docs.sparkSession
    ring = points(shards, vnodes)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33).cast("int").alias("place"),
                       F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"))
    base = written(base.withColumn("arc", arc_of(F.col("place"), ring)).drop("place"), "ring-rows")

    counts = base.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "ring-starts")
    loads = {r.arc: r.n for r in starts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = assign(loads, ring, bounds(sum(loads.values()), shards, slack))
    segments = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), "array<struct<arc:int,lo:long,hi:long,shard:int,slot:long>>")).alias("s")).select("s.*")

    inside = Window.partitionBy("arc", "part").orderBy("doc_id", "size", "text_crc32")
    ranked = base.withColumn("rank", (F.row_number().over(inside) - 1).cast("long")).join(starts.drop("n"), ["arc", "part"]).withColumn("rank", F.col("rank") + F.col("start"))
    placed = ranked.join(F.broadcast(segments.withColumnRenamed("arc", "_arc")), (F.col("arc") == F.col("_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"))
