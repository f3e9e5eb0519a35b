"""Sharding by minimax contiguous partition: all copies of a text in one shard, shards of nearly equal bytes.

Groups (equal texts, by a 64-bit hash; null and empty texts are one group) stand in one order: first those of more
than 1/1024 of all bytes (``LARGE``; at most as many), the largest first, then the others by their hash, which mixes
lengths.  The smallest capacity is sought by bisection for which cutting greedily along that order needs no more
than the given number of shards.  The first shard is cut there; the rest is cut in the same way into the other
shards, so that one great group does not leave later shards empty.

Groups are never gathered.  The driver sees the order as at most a few ten thousand ranges of hashes with their
bytes.  A capacity is tried with each range taken as one piece and as divisible, which bounds every cut from both
sides; ranges in which a cut may lie are split further by one aggregation over the table of groups, until each of
these is a single group.  So the cuts are exact at any number of groups.  A cut is a hash, and rows find their shard
by comparing hashes, the large groups by a broadcast of at most 1024 rows.

Slots of a shard are in the order of a hash of id and text, gapless from 0; they come from running totals over
buckets of distinct (id, text), so neither a shard nor a group of copies nor many rows of one id meet in a task.

Defined results: a null text has no bytes; every row has a size of at least 1; a null id is an id of its own;
repeated rows are rows of their own with slots next to each other; fewer groups than shards leave the last shards
empty; an empty table gives an empty table; other columns are passed on, and ones named like a result give way to it.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, null_safe, running

SHARDS = 8
#: Groups of more than one in so many bytes are placed one by one.
LARGE = 1024
#: Bits of the hash by which the order is first split, and by which a range is split further.
FIRST, MORE = 12, 9
#: Buckets of rows, for their slots.
BUCKETS = 1024


@dataclass(frozen=True)
class Piece:
    """A stretch of the order: a large group (``lo`` is its hash), or the small ones of 2^bits hashes from ``lo``."""

    lo: int
    bits: int
    size: int
    single: bool
    large: bool = False


class Order:
    """The pieces with their running total, and greedy cuts along them."""

    def __init__(self, pieces: list[Piece]):
        self.pieces, self.ends, total = pieces, [], 0
        for p in pieces:
            total += p.size
            self.ends.append(total)
        self.total = total

    def cut(self, start: int, capacity: int, whole: bool) -> int:
        """Where a shard that begins at ``start`` ends.  Ranges are divisible unless ``whole``."""
        limit = start + capacity
        if limit >= self.total:
            return self.total
        k = bisect_right(self.ends, limit)  # the piece that the limit lies in
        if whole or self.pieces[k].single:
            return max(start, self.ends[k - 1] if k else 0)
        return limit

    def cuts(self, start: int, capacity: int, shards: int, whole: bool) -> list[int]:
        found = [start]
        for _ in range(shards):
            found.append(self.cut(found[-1], capacity, whole))
        return found[1:]

    def least(self, start: int, shards: int, whole: bool) -> int:
        """The smallest capacity with which the shards hold all from ``start`` on."""
        low, high = -(-(self.total - start) // shards), self.total - start
        while low < high:
            middle = (low + high) // 2
            if self.cuts(start, middle, shards, whole)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def between(self, low: int, high: int) -> list[Piece]:
        """The divisible pieces that lie in part between two places of the order."""
        first, last = bisect_right(self.ends, low), bisect_right(self.ends, high)
        return [p for p in self.pieces[first : last + 1] if not p.single]


def _split(groups: DataFrame, ranges: list[Piece], more: int) -> list[Piece]:
    """The pieces of ranges of one width, each split by its next ``more`` bits."""
    width = ranges[0].bits
    fine = max(0, width - more)
    wanted = groups if width == 64 else groups.where(F.shiftright("g", width).isin([p.lo >> width for p in ranges]))
    rows = wanted.groupBy(F.shiftright("g", fine).alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [Piece(r["b"] << fine, fine, r["size"], r["n"] == 1) for r in rows]


def plan(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The large groups' shards as (hash, shard), and for the others (first hash, shard), by rising hash, of the
    stretches of each shard.  ``groups``: g (long, unique), size."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = groups.where(F.col("size") * F.lit(LARGE) > F.lit(total)).orderBy(F.desc("size"), "g").collect()  # under LARGE rows
    small = groups.where(F.col("size") * F.lit(LARGE) <= F.lit(total))
    head = [Piece(r["g"], 0, r["size"], True, True) for r in large]
    tail = _split(small, [Piece(0, 64, 0, False)], FIRST)

    def ordered() -> Order:
        return Order([*head, *sorted(tail, key=lambda p: p.lo)])

    order, start, ends = ordered(), 0, []
    for left in range(shards, 0, -1):
        while True:
            low, high = order.least(start, left, whole=False), order.least(start, left, whole=True)
            spans = zip(order.cuts(start, low, left, whole=True), order.cuts(start, high, left, whole=False), strict=True)
            unsure = {p for a, b in spans if a != b for p in order.between(a, b)}
            if not unsure:  # then both bounds give the same cuts
                break
            tail = [p for p in tail if p not in unsure]
            for width in {p.bits for p in unsure}:
                tail += _split(small, [p for p in unsure if p.bits == width], MORE)
            order = ordered()
        start = order.cut(start, high, whole=True)
        ends.append(start)

    placed, firsts, at, shard = [], [], 0, 0
    for piece, end in zip(order.pieces, order.ends, strict=True):
        while at >= ends[shard] and shard < shards - 1:
            shard += 1
        if piece.large:
            placed.append((piece.lo, shard))
        elif not firsts or firsts[-1][1] != shard:
            firsts.append((piece.lo, shard))
        at = end
    return placed, firsts


def shard(df: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, name: str = "sharding") -> DataFrame:
    """The columns ``keep`` of the input (all, if not given) with ``size``, ``shard`` and ``slot``."""
    scratch, spark = Scratch(df.sparkSession, name), df.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    # Rows are numbered in a table that stands, so their numbers do not change when a task is run again.
    rows = scratch.cut(df.select(
        own.alias("row"), F.col(doc_id).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("g"), size.alias("size"), F.monotonically_increasing_id().alias("r"),
    ))
    groups = scratch.cut(rows.groupBy("g").agg(F.sum("size").alias("size")))
    placed, firsts = plan(groups, shards)
    of_hash = F.lit(0)
    for first, k in firsts:
        of_hash = F.when(F.col("g") >= F.lit(first), F.lit(k)).otherwise(of_hash)
    known = spark.createDataFrame(pa.table({"g": pa.array([g for g, _ in placed], pa.int64()), "placed": pa.array([k for _, k in placed], pa.int32())}))  # under LARGE rows
    dealt = rows.select("d", "g", "r").join(F.broadcast(known), "g", "left").withColumn("shard", F.coalesce("placed", of_hash).cast("int")).drop("placed")

    key = ["d", "g"]
    distinct = dealt.groupBy("shard", *key).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("d", "g", F.lit(1)))
    distinct = scratch.cut(distinct.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))))
    offsets = running(distinct, ["shard"], "bucket", [("n", "offset", "sum")])
    within = W.partitionBy("shard", "bucket").orderBy("h", *key).rowsBetween(W.unboundedPreceding, -1)
    first = distinct.join(offsets, ["shard", "bucket"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    met = scratch.cut(null_safe(dealt, first.select(*key, "n", "first"), key))
    once = met.where("n = 1").select("r", "shard", F.col("first").alias("slot"))
    # Rows that share id and text are ranked by their numbers, over buckets of these.
    twice = met.where("n > 1").withColumn("bucket", F.pmod(F.xxhash64("r"), F.lit(64)))
    before = running(twice.withColumn("one", F.lit(1)), ["shard", "first"], "bucket", [("one", "offset", "sum")])
    rank = F.row_number().over(W.partitionBy("shard", "first", "bucket").orderBy("r")) - 1
    twice = twice.join(before, ["shard", "first", "bucket"]).select("r", "shard", (F.col("first") + F.col("offset") + rank).alias("slot"))
    found = rows.select("r", "row", "size").join(once.union(twice), "r")
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("size", "shard", "slot")]
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "size", "shard", F.col("slot").cast("long").alias("slot"))
