"""SimHash near-duplicates by covering locality-sensitive hashing.

(For shingle widths without a radius, ``groups`` and ``keep_one`` take the pairs within ``CANDIDATES`` of each other as
candidates, check their overlap exactly, and add what no small radius reaches: see ``overlap``.)

Every pair of fingerprints within the radius r agrees on the kept bits of at least one of 2^(r+1) - 1 masks:
bit i has a vector m(i) over GF(2) of r + 1 dimensions, mask v keeps bit i if <m(i), v> = 1, and at most r
differing bits leave some v orthogonal to all of their vectors.  So no pair is missed, whatever the data.

Copies are one fingerprint, so only distinct fingerprints are compared.  A bucket is compared in tiles of
bounded size; each tile returns a spanning forest of its links and never its pairs, and connected components
join the forests.  A bucket of any size is exact: more tiles, on more tasks.

Defined results: a null text is the empty text; a text without words has fingerprint zero and links like any
other; a null doc_id takes part in a group but never names one (component_id is null if the group has no
other); repeated rows each get a row; an empty table gives an empty table.  Ids are integers, or text of them; other
text is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import overlap
from .common import Scratch, consumed, fresh, lean, ship
from .components import connected

BITS = 64
#: Rows of a tile; two tiles are compared at a time.
TILE = 1024
#: Shingles turned into bits at a time.
CHUNK = overlap.CHUNK


def fingerprint(text: str, width: int, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer.  A-Z are lower-cased; words are runs of
    anything but ASCII white space; a text of fewer words than ``width`` is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    last = ends[min(width, len(words)) - 1 :]
    ones, n, h = np.zeros(BITS, np.int64), len(last), xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        ones += overlap.ones(np.array([h(joined[a : b - 1], seed) for a, b in zip(starts[k : k + CHUNK], last[k : k + CHUNK], strict=False)], "<u8"))
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, width: int, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fp``."""
    schema = T.StructType([*[df.schema[c] for c in carry], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                found = pa.array([fingerprint(t.as_py() or "", width) for t in batch.column(len(carry))], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], found], names=schema.names)

    ship(df.sparkSession)
    return df.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit integers."""
    n = (1 << (radius + 1)) - 1
    vectors = [(i * 37) % n + 1 for i in range(BITS)]
    found = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2)
        found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def _forest(x: np.ndarray, radius: int) -> np.ndarray:
    """For each of the fingerprints the smallest one that links lead to within the set."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = x.view(np.int64).copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links whose closure is that of all pairs of ``fps.fp`` (distinct) within the radius."""
    tables = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("k"))
    buckets = scratch.cut(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")

    many = buckets.where("n > 2").select("k", F.ceil(F.col("n") / TILE).cast("int").alias("t"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("t")).cast("int")
    tiled = keyed.join(many, "k").withColumn("o", own).select("k", "fp", "o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("p"))
    tiled = tiled.select("fp", F.xxhash64("k", F.least("o", "p"), F.greatest("o", "p")).alias("g"))
    dealt = tiled.repartition("g").sortWithinPartitions("g", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[np.ndarray]:
            held_g, held = None, []
            for batch in batches:
                g, fp = (np.asarray(batch.column(c)) for c in ("g", "fp"))
                cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    if s == e:
                        continue
                    if held and g[s] != held_g:
                        yield np.concatenate(held)
                        held = []
                    held_g = g[s]
                    held.append(fp[s:e])
            if held:
                yield np.concatenate(held)

        a, b = [], []
        for group in groups():
            x = group.view(np.uint64)
            label = _forest(x, radius)
            other = label != group
            if other.any():
                a.append(group[other])
                b.append(label[other])
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    ship(fps.sparkSession)
    return pairs.union(dealt.mapInArrow(compare, "a long, b long"))


#: The radius of a shingle width; no radius reaches 0.8 of overlap, so widths without one link by overlap itself.
RADIUS = {4: 4}
#: The radius within which such widths take candidates.
CANDIDATES = 4


def candidates(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of sids (of sid, ``fp``) that tie all fingerprints within ``CANDIDATES`` of each other."""
    firsts = scratch.cut(sets.groupBy("fp").agg(F.min("sid").alias("m")))
    same = sets.join(firsts, "fp").where("sid <> m").select(F.col("m").alias("a"), F.col("sid").alias("b"))
    near = links(firsts.select("fp"), CANDIDATES, scratch)
    for c in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(c), F.col("m").alias(f"s{c}")), c)
    return scratch.cut(same.union(near.where("sa <> sb").select("sa", "sb")))


def groups(df: DataFrame, width: int = 4, radius: int | None = None, text: str = "text", doc_id: str = "doc_id", name: str = "simhash") -> DataFrame:
    """doc_id, ``text_hash``, ``group`` (the same for all that links lead to) and ``component_id`` (the group's
    smallest doc_id) of every row, and ``fp`` where links are fingerprints within the radius."""
    radius = RADIUS.get(width) if radius is None else radius
    if radius is None:
        return overlap.groups(df, width, text, doc_id, name, candidates)
    scratch = Scratch(df.sparkSession, name)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    docs = scratch.cut(fingerprints(docs, width, carry=("doc_id", "text_hash")))
    fps = scratch.cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(fps, radius, scratch), scratch).withColumnRenamed("node", "fp")
    nodes = scratch.cut(fps.join(roots, "fp", "left").withColumn("group", F.coalesce("root", "fp")).drop("root"))
    firsts = nodes.groupBy("group").agg(F.min("first").alias("component_id"))
    named = nodes.join(firsts, "group").select("fp", "group", "component_id")
    return docs.join(named, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def keep_one(df: DataFrame, width: int = 5, radius: int | None = None, text: str = "text", doc_id: str = "doc_id", name: str = "simhash") -> DataFrame:
    """The input with one row of each group: that of the smallest doc_id (nulls last; of equal ones the
    smallest hash of the text; of equal rows one)."""
    scratch = Scratch(df.sparkSession, f"{name}-kept")
    with consumed():  # of the groups only the rows that stay are needed
        found = groups(df, width, radius, text, doc_id, name)
        first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("k"))
        # Plain keys, so that the join's partitions serve the removal of equal rows too.
        names = fresh(df, "_id", "_null", "_hash")
        keys = lambda i, h: dict(zip(names, (F.coalesce(i, F.lit(0)), i.isNull(), h), strict=True))
        keepers = scratch.cut(first.select(*[c.alias(k) for k, c in keys(F.col("k.doc_id"), F.col("k.text_hash")).items()]))
    keyed = df.withColumns(keys(F.col(doc_id).cast("long"), F.xxhash64(text)))
    return keyed.join(keepers.hint("merge"), names).dropDuplicates(names).drop(*names)
