"""Contiguous sharding: the smallest capacity at which a greedy pass over ordered groups needs no more than the shards.

Equal texts are one group, groups stand in the order of their smallest doc_id, and a shard is a stretch of groups. The
capacity is found by binary search, each candidate checked greedily. Neither needs the groups on the driver: it sees at
most POINTS summed blocks of each stretch in which a cut can fall. Cuts only move forward as the capacity grows, so the
blocks bound every cut from both sides; the next round divides only the stretches between these bounds, until the
bounds meet and the capacity and its cuts are exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, gapless, table

SHARDS = 24
POINTS = 2048


def _ordered_groups(rows: DataFrame) -> DataFrame:
    """(group, start, end): each group's place on the line of all bytes, by running sums over ranges of the order."""
    groups = rows.groupBy("group").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"))
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(cut(groups).repartitionByRange(n, "first", "group").withColumn("range", F.spark_partition_id()))
    # one row for each range, of which there are as many as shuffle partitions
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("range").agg(F.sum("size").alias("total")).select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("at"))
    own = F.sum("size").over(W.partitionBy("range").orderBy("first", "group").rowsBetween(W.unboundedPreceding, 0))
    ends = dealt.withColumn("own", own).join(F.broadcast(offsets), "range")
    return cut(ends.select("group", (F.col("at") + F.col("own") - F.col("size")).alias("start"), (F.col("at") + F.col("own")).alias("end")))


class Line:
    """Known group ends, in order, and the blocks between two known ones that hold further ends."""

    def __init__(self, blocks: list[tuple[int, int, int]]) -> None:
        """blocks: (first end, last end, groups), in order, each group's end in one block."""
        self.blocks = blocks
        self.starts = [b[0] for b in blocks]

    def reach(self, most: int, hopeful: bool) -> int:
        """The last group end up to most: at least that (or at most, if hopeful), where a block hides it."""
        k = bisect_right(self.starts, most) - 1
        if k < 0:
            return 0
        first, last, n = self.blocks[k]
        if last <= most:
            return last
        return first if n <= 2 else most if hopeful else first

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = max(at, self.reach(at + capacity, hopeful))
            out.append(at)
        return out

    def smallest(self, low: int, high: int, shards: int, total: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity that covers the line."""
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, hopeful)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int, points: int = POINTS) -> tuple[int, list[int]]:
    """The smallest capacity, and where the shards end at it; groups has start and end on one line without gaps."""
    total, largest = groups.agg(F.max("end"), F.max(F.col("end") - F.col("start"))).first()
    if not total:
        return 0, [0] * shards
    low, high = max(largest, -(-total // shards)), total
    stretches = [(0, total)]
    while True:
        # blocks of equal width in each stretch: at most points of them, numbered through
        number, base = F.lit(None).cast("long"), 0
        for a, b in stretches:
            width = -(-(b - a) // points)
            own = F.expr(f"(`end` - {a + 1}) div {width}")
            number = F.when((F.col("end") > a) & (F.col("end") <= b), own + F.lit(base)).otherwise(number)
            base += points
        rows = groups.select("end", number.alias("block")).filter("block is not null").groupBy("block")
        found = sorted((r.first, r.last, r.n) for r in rows.agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n")).collect())
        line = Line(found)
        low = line.smallest(low, high, shards, total, hopeful=True)
        high = line.smallest(low, high, shards, total, hopeful=False)
        if low == high:
            return low, line.cuts(low, shards, hopeful=False)
        near, far = line.cuts(low, shards, hopeful=False), line.cuts(high, shards, hopeful=True)
        stretches, at = [], 0
        for a, b in zip(near, far, strict=True):  # the stretches in which each cut can be
            a = max(a - 1, at)
            if b > a:
                stretches.append((a, b))
                at = b


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts stay together, slots count from 0 in each shard.

    size is the text's UTF-8 bytes plus 8. A null text counts as an empty one and is in its group. Repeated rows each
    have a slot; rows with a null doc_id come first. A group larger than an even share has a shard of its own; fewer
    groups than shards leave shards empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    rows = cut(rows)
    groups = _ordered_groups(rows)
    _, ends = minimax_cuts(groups, shards)
    shard = sum(((F.col("end") > F.lit(x)).cast("int") for x in ends[:-1]), F.lit(0))
    placed = rows.join(groups.select("group", shard.alias("shard")), "group").drop("group")
    return gapless(cut(placed), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard and slot when contiguous groups of equal texts fill SHARDS shards near equally."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def brute_force(sizes: list[int], shards: int) -> int:
    """The smallest capacity, by trying all of them; for tests."""
    for capacity in range(max(sizes, default=0), sum(sizes) + 1):
        used, room = 0, 0
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity
    return 0
