"""Near-duplicates by exact overlap (Jaccard) of word shingles, 0.8 or more.

Candidates come from keys of each text, of which two texts within the threshold share one.  All shingles have one
order: what is common in a sample comes last, then by hash.  The keys are the smallest shingle of every window of
w shingles in a row, w = 0.44 n but ``WINDOW`` at most for a text of n different shingles.  Two texts within the
threshold differ by at most one change per 81 shingles of both (a change inside a text costs them 9 shingles or
more), so they share a run of w shingles, and the smallest shingle of that run is a key of both.  Where a window
holds nothing but common shingles its key would gather all texts that share the passage; such keys are left out, and
the text takes the first n - ceil(0.8 n) + 1 of its shingles as keys besides: of those any two sets within the
threshold share one, and both texts of the run take them.  The sample decides the order alone, never the result.

Pairs of a bucket are dropped by size and by a sketch of 1024 parities, whose distance is never more than that of
the sets.  Of long texts that distance is always small enough, so texts of more shingles have a wide sketch besides, of
two to four parities a shingle; what both leave is compared shingle by shingle.

Texts of equal shingles are one set.  A caller may give pairs of sets to begin with (SimHash does); those that the
exact comparison confirms are links, and what they connect is not compared again.  Each bucket then ties its members to its smallest one, then those that are in
different components still to ``HUBS`` more in each of ``ROUNDS`` rounds, and then only pairs that all these leave in
different components are compared, in tiles of bounded size: a large group costs its members and not its pairs.

Defined results: a null text is the empty text; texts without words are one group; a null doc_id takes part in a
group but never names one; repeated rows each get a row; an empty table gives an empty table.  Ids are integers, or
text of them; other text is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Scratch, lean, ship
from .components import connected

#: Texts whose shingles are counted for the order, about; the count from which a shingle is common; common ones at most.
SAMPLE, COMMON, MOST = 20_000, 4, 200_000
#: 64-bit words of a sketch.
WORDS = 16
#: Shingles of a window at most.
WINDOW = 24
#: Rows of a tile; two tiles are compared at a time.
TILE = 1024
#: Members of a bucket that are tied to those in other components, in each of at most so many rounds, before what is
#: left is compared in tiles.
HUBS, ROUNDS = 12, 3
#: Sets that may be broadcast as ids (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

#: Hashes turned into bits at a time.
CHUNK = 1 << 15

_SKETCH = [f"s{i}" for i in range(WORDS)]


def sequence(text: str, width: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles in order, which are those of ``simhash.fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate([len(w) + 1 for w in words]))
    last = ends[min(width, len(words)) - 1 :]
    return np.array([h(joined[a : b - 1], seed) for a, b in zip([0, *ends], last, strict=False)], np.uint64)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(row: np.ndarray) -> int:
    """``simhash.fingerprint`` of the text that has these shingles."""
    if not len(row):
        return 0
    total = sum(ones(row[k : k + CHUNK]) for k in range(0, len(row), CHUNK))
    return int(np.packbits(2 * total > len(row), bitorder="little").view("<i8")[0])


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(sequence(text, width))


def sketch(own: np.ndarray, parts: int = 64 * WORDS) -> np.ndarray:
    """For each of so many parts of the hashes, whether an odd number of the set's lies in it."""
    odd = np.bincount((own % np.uint64(parts)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide(own: np.ndarray) -> np.ndarray | None:
    """The sketch in parts that are a power of two, two to four a shingle; none where ``sketch`` has as many shingles
    as parts or fewer.  The halves of one, combined by XOR, are that of half as many parts."""
    return sketch(own, 1 << (2 * len(own) - 1).bit_length()) if len(own) > 64 * WORDS else None


def _weight(x: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often the sample has each shingle; 0 for all but the common ones."""
    if not len(common):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    return np.where(common[at] == x, counts[at], 0)


def keys(row: np.ndarray, own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of a text with the shingles ``row``, in order, and ``own``, distinct; two texts within the threshold
    share one."""
    if not len(own):
        return own
    weight = _weight(row, common, counts)
    order = np.lexsort((row, weight))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row))
    least = order[np.unique(np.lib.stride_tricks.sliding_window_view(rank, max(1, min(WINDOW, int(0.44 * len(own))))).min(1))]
    found = row[least[weight[least] == 0]]
    if len(found) < len(least):
        first = np.lexsort((own, _weight(own, common, counts)))[: len(own) - -(-4 * len(own) // 5) + 1]
        found = np.concatenate([found, own[first]])
    return np.unique(found)


def _sets(df: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """key and ``x`` (the hashes of its text's shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                found = pa.array([shingles(t.as_py() or "", width).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "x"])

    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"{key} long, x array<long>")


def _order(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the sample's common shingles."""
    one_in = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod("text_hash", F.lit(one_in)) == 0).groupBy("text_hash").agg(F.min("text").alias("text"))
    counted = _sets(some, width, "text_hash", "text").select(F.explode("x").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "x").limit(MOST).collect()
    found = sorted((r["x"] % (1 << 64), r["n"]) for r in rows)
    return np.array([x for x, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, ``sid`` (the same for texts of equal shingles), ``fp`` (the SimHash), ``n``, ``keys`` and the sketches."""
    order = docs.sparkSession.sparkContext.broadcast(_order(docs, width))  # MOST entries at most
    names = ["doc_id", "text_hash", "sid", "fp", "n", "keys", "wide", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                sid, fp, n, found, wider, parities = [], [], [], [], [], []
                for t in batch.column(2):
                    row = sequence(t.as_py() or "", width)
                    own = np.unique(row)
                    sid.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                    fp.append(fingerprint(row))
                    n.append(len(own))
                    found.append(keys(row, own, *order.value).view(np.int64))
                    wider.append(wide(own))
                    parities.append(sketch(own))
                words = np.array(parities, np.int64).reshape(-1, WORDS)
                arrays = [pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in (found, wider)]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, *[pa.array(words[:, i]) for i in range(WORDS)]], names=names)

    schema = T.StructType([T.StructField(c, T.ArrayType(T.LongType()) if c in ("keys", "wide") else T.LongType()) for c in names])
    return docs.mapInArrow(run, schema)


def _fits(na: Column, nb: Column) -> Column:
    return 5 * F.least(na, nb) >= 4 * F.greatest(na, nb)


def _may(a: str, b: str) -> Column:
    """Whether the sketches allow 0.8: the sets then differ in at most a ninth of their sizes' sum."""
    distance = reduce(add, [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH])
    return 9 * distance <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _still_may(a: str, b: str) -> Column:
    """Whether the wide sketches, if both sets have one, allow 0.8.  Sizes fit, so one has twice the parts at most."""
    def folded(x: Column, y: Column) -> Column:
        n = F.array_size(y)
        halves = F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda s, t: s.bitwiseXOR(t))
        return F.when(F.array_size(x) > n, halves).otherwise(x)

    x, y = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    bits = F.zip_with(folded(x, y), folded(y, x), lambda s, t: F.bit_count(s.bitwiseXOR(t)))
    return F.coalesce(9 * F.aggregate(bits, F.lit(0), add) <= F.col(f"{a}.n") + F.col(f"{b}.n"), F.lit(True))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def _exact(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b), of sizes that fit, whose overlap is 0.8 or more."""
    asked = scratch.cut(pairs)
    known = scratch.cut(_ids(asked).join(sets.select("sid", "text_hash", "n", "wide"), "sid"))
    sketched = asked.join(known.alias("p"), F.col("a") == F.col("p.sid")).join(known.alias("q"), F.col("b") == F.col("q.sid"))
    pairs = scratch.cut(sketched.where(_still_may("p", "q")).select("a", "b"))
    wanted = scratch.cut(_ids(pairs).join(known.select("sid", "text_hash"), "sid"))
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "text_hash").groupBy("sid").agg(F.min("text").alias("text"))
    held = scratch.cut(_sets(texts, width, "sid", "text"))
    both = pairs.join(held.select(F.col("sid").alias("a"), F.col("x").alias("xa")), "a").join(held.select(F.col("sid").alias("b"), F.col("x").alias("xb")), "b")
    found = scratch.cut(both.where(9 * F.size(F.array_intersect("xa", "xb")) >= 4 * (F.size("xa") + F.size("xb"))).select("a", "b"))
    for done in (asked, known, pairs, wanted, held):
        scratch.drop(done)
    return found


def _hub(seed: int) -> Column:
    """One member of a bucket, whichever has the smallest hash."""
    return F.min(F.struct(F.xxhash64("sid", F.lit(seed)).alias("h"), "sid", "n", "c"))


def _ties(stars: DataFrame, sets: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of ``stars`` whose overlap is 0.8 or more."""
    sketches = sets.select("sid", "n", *_SKETCH)
    tied = stars.distinct().join(sketches.alias("p"), F.col("a") == F.col("p.sid")).join(sketches.alias("q"), F.col("b") == F.col("q.sid"))
    return _exact(tied.where(_fits(F.col("p.n"), F.col("q.n")) & _may("p", "q")).select("a", "b"), sets, docs, width, scratch)


def _apart(pairs: DataFrame, ties: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that the ties do not connect already."""
    roots = scratch.cut(connected(ties, scratch))
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _links(members: DataFrame, sets: DataFrame, docs: DataFrame, width: int, scratch: Scratch, ties: DataFrame | None = None) -> DataFrame:
    """(a, b): links whose closure is that of all pairs of sets within the threshold; ``members``: sid, n, k; ``ties``:
    links that are known."""
    members = scratch.cut(members)
    buckets = scratch.cut(members.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("sid", "n")).alias("m")).where("size > 1"))
    shared = scratch.cut(members.join(buckets, "k"))
    for done in (members, buckets):
        scratch.drop(done)
    stars = shared.where((F.col("sid") != F.col("m.sid")) & _fits(F.col("n"), F.col("m.n"))).select(F.col("m.sid").alias("a"), F.col("sid").alias("b"))
    if ties is None:
        ties = _ties(stars, sets, docs, width, scratch)
    else:
        ties = ties.union(_ties(_apart(stars.distinct(), ties, scratch), sets, docs, width, scratch))
    many, rounds = shared.where("size > 2").select("k", "sid", "n", "size"), 0
    while True:
        roots = scratch.cut(connected(ties, scratch).withColumnRenamed("node", "sid"))
        left = many.join(roots, "sid", "left").withColumn("c", F.coalesce("root", "sid")).drop("root")
        mixed = left.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.array(*[_hub(HUBS * rounds + i) for i in range(HUBS)]).alias("hubs")).where("x <> y")
        mixed = scratch.cut(mixed.drop("x", "y"))
        left = scratch.cut(left.join(mixed.select("k"), "k"))
        if rounds == ROUNDS:
            break
        # Hubs of the bucket, most of which are of its largest component, are tied to what is in other components.
        stars = left.join(mixed, "k").withColumn("m", F.explode("hubs")).where((F.col("c") != F.col("m.c")) & _fits(F.col("n"), F.col("m.n")))
        found = _ties(stars.select(F.least("sid", "m.sid").alias("a"), F.greatest("sid", "m.sid").alias("b")), sets, docs, width, scratch)
        rounds = rounds + 1 if found.count() else ROUNDS
        ties = ties.union(found)
        for done in (left, mixed, roots):
            scratch.drop(done)

    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tiled = left.withColumn("t", tiles).withColumn("o", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("t")).cast("int"))
    tiled = tiled.select("k", "sid", "c", "o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("p"))
    tiled = tiled.select("sid", "c", F.xxhash64("k", F.least("o", "p"), F.greatest("o", "p")).alias("g"))
    tiled = scratch.cut(tiled.join(sets.select("sid", "n", *_SKETCH), "sid"))
    on = (F.col("p.g") == F.col("q.g")) & (F.col("p.sid") < F.col("q.sid")) & (F.col("p.c") != F.col("q.c")) & _fits(F.col("p.n"), F.col("q.n")) & _may("p", "q")
    crossing = tiled.alias("p").join(tiled.alias("q"), on).select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b")).distinct()
    ties = ties.union(_exact(crossing, sets, docs, width, scratch))
    for done in (tiled, left, mixed, roots, shared):
        scratch.drop(done)
    return ties


def groups(df: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id", name: str = "overlap",
           candidates: Callable[[DataFrame, Scratch], DataFrame] | None = None) -> DataFrame:
    """doc_id, ``text_hash``, ``group`` (the same for all that links lead to) and ``component_id`` (the group's
    smallest doc_id) of every row.  ``candidates`` makes of (sid, fp) the pairs (a, b) of sids to begin with."""
    scratch = Scratch(df.sparkSession, name)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    found = scratch.cut(_described(docs, width))
    sets = scratch.cut(found.drop("keys", "fp").groupBy("sid").agg(*[F.min(c).alias(c) for c in ("doc_id", "text_hash", "n", "wide", *_SKETCH)]))
    # Texts of one set whose order differs may have different keys; all count.
    described = found.select("sid", "n", "keys", F.xxhash64("keys").alias("kh")).dropDuplicates(["sid", "kh"])
    members = described.select("sid", "n", F.explode("keys").alias("k"))
    first = candidates and _ties(candidates(found.select("sid", "fp").distinct(), scratch), sets, docs, width, scratch)
    roots = connected(_links(members, sets, docs, width, scratch, first), scratch).withColumnRenamed("node", "sid")
    nodes = scratch.cut(sets.select("sid", "doc_id").join(roots, "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("group")))
    firsts = nodes.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = nodes.select("sid", "group").join(firsts, "group")
    return found.select("doc_id", "text_hash", "sid").join(named, "sid").select("doc_id", "text_hash", "group", "component_id")
