"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; longs): root is the component's smallest node.

    Each step is aggregations and equi-joins over the edges, cut to a table in the shared folder; no
    component is ever gathered in one task.  Self-loops and repeated edges do not matter; no edges give no
    rows.  A hub's edges are one join key, which adaptive execution splits.
    """
    now = scratch.cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        # Large star: what lies above v moves to the smallest neighbour of v.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(least.withColumnRenamed("u", "v"), "v", "left")
        large = scratch.cut(moved.select("u", F.coalesce("m", "v").alias("v")).distinct())
        # Small star: the smaller neighbours of u, and u, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = scratch.cut(moved.where("e.u <> e.m").select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).distinct())
        scratch.drop(now)
        scratch.drop(large)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
