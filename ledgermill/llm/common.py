"""Shared pieces: scratch tables that survive lost executors, distributed running totals, row keys."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).  Where it is unset a local session gets a
    temporary one; on a cluster that would be another folder on every machine, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgermill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it, for Python tasks."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, for Python stages where it is not installed: Spark's own file server
    hands out the archive, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgermill_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="ledgermill-")) / "ledgermill_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._ledgermill_shipped = True


@contextmanager
def lean(*caches: dict) -> Iterator[None]:
    """Around a Python stage's loop.  Scanning for cycles is off inside, as batches make many objects and no
    cycles; at the end the caches are emptied and memory goes back, because the worker lives on."""
    gc.disable()
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


#: The scratch made inside the innermost ``consumed`` block of this thread.
_own: ContextVar[list[Scratch] | None] = ContextVar("own", default=None)


class Scratch:
    """Tables in the shared folder.  ``cut`` ends a lineage: the table it returns is read from files, so a
    lost executor costs a re-read and not the steps before it.  An operator's result is lazy; what it still
    reads is the last table that ``settle`` keeps, and ``consumed`` removes that for the caller that has
    written the result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []
        own = _own.get()
        if own is not None:
            own.append(self)

    def cut(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self.paths.append(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def settle(self, df: DataFrame) -> DataFrame:
        """Cuts a table on which alone the result depends, and removes the tables before it."""
        before = list(self.paths)
        kept = self.cut(df)
        for path in before:
            self._remove(path)
        return kept

    def drop(self, df: DataFrame) -> None:
        """Removes a table that ``cut`` made and nothing will read again."""
        self._remove(df._scratch_path)

    def remove(self) -> None:
        """Removes all of its tables."""
        self._remove(self.root)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = [p for p in self.paths if p != name]


@contextmanager
def consumed() -> Iterator[None]:
    """Whoever writes operators' results inside of this block leaves none of their tables behind, whether the block
    ends well or not.  Blocks of other threads, and results made outside of any block, are not touched."""
    made: list[Scratch] = []
    token = _own.set(made)
    try:
        yield
    finally:
        _own.reset(token)
        for scratch in made:
            scratch.remove()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the input does not have, whatever its columns are called."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, nulls told from values.  Maps cannot be hashed and are left out."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    nulls = F.concat(F.lit("n"), *[F.when(c.isNull(), "1").otherwise("0") for c in hashed])
    return [F.xxhash64(nulls, *hashed, F.lit(seed)) for seed in (1, 2)]


def running(df: DataFrame, group: list[str], bucket: str, specs: list[tuple[str, str, str]]) -> DataFrame:
    """For each (group, bucket) totals over the group's smaller buckets.

    ``specs``: (column, output, "sum" or "max"); an empty sum is 0, an empty max null.  One group's bucket
    totals are an array as long as its number of buckets, which the caller bounds; no task sees a group's
    rows.  Group columns may be null.
    """
    own = [(F.coalesce(F.sum(c), F.lit(0)) if kind == "sum" else F.max(c)).cast("long").alias(f"_{o}") for c, o, kind in specs]
    sums = df.groupBy(*group, F.col(bucket).cast("long").alias(bucket)).agg(*own)
    fields = [f"_{o}" for _, o, _ in specs]
    arrays = sums.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(bucket).alias("b"), *fields))).alias("_a"))
    empty = F.struct(*[(F.lit(0) if kind == "sum" else F.lit(None)).cast("long").alias(o) for _, o, kind in specs])
    kind_of = ", ".join(f"{o}: bigint" for _, o, _ in specs)

    def step(acc, x):
        after = [(acc["t"][o] + x[f"_{o}"] if kind == "sum" else F.greatest(acc["t"][o], x[f"_{o}"])).alias(o) for _, o, kind in specs]
        entry = F.struct(x["b"].alias("b"), *[acc["t"][o].alias(o) for _, o, _ in specs])
        return F.struct(F.struct(*after).alias("t"), F.concat(acc["r"], F.array(entry)).alias("r"))

    start = F.struct(empty.alias("t"), F.expr(f"cast(array() as array<struct<b: bigint, {kind_of}>>)").alias("r"))
    rows = arrays.select(*group, F.explode(F.aggregate("_a", start, step, lambda acc: acc["r"])).alias("_x"))
    return rows.select(*group, F.col("_x.b").alias(bucket), *[F.col(f"_x.{o}").alias(o) for _, o, _ in specs])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the right side's keys are dropped."""
    names = dict(zip(keys, fresh(left, *[f"_r_{k}" for k in keys]), strict=True))
    renamed = right.withColumnsRenamed(names)
    on = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[names[k]])
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*names.values())
