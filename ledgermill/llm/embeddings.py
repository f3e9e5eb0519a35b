"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to their principal axes, so that leading dimensions carry most of
every product.  Two tiles are compared in steps: boxes of the leading coordinates and the norms of what follows bound
the tiles' best cosine, and the pair of tiles is left if that cannot reach the threshold; then products are
accumulated over ``LEAD`` dimensions, twice as many, and so on, after each step what is left of each product is bounded
by the suffix norms, and the tiles are left as soon as no pair can reach the threshold; once few pairs still can, only
these are finished.  The bounds are exact (Cauchy-Schwarz), so no link is lost; pairs within 1e-9 of the threshold are
decided by the unrotated vectors in double precision.

Copies of a vector are one row with a multiplicity.  Vectors are dealt into blocks of ``BLOCK`` rows, twice that at
most, and each block is written once to the folder that the cluster shares.  A pair of blocks is a unit of work: its
task opens the two files, whatever their number, and returns for each row the number of its links and a spanning forest,
never the pairs.  Comparing all with all is quadratic in the number of distinct vectors but for what the boxes prune;
more executors shorten it, as pairs of blocks are dealt out over all of them.

The axes and the tree that deals vectors into blocks are fitted on a sample of ``SAMPLE`` vectors.  They shape what
the comparison costs, never what it finds.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, links with
nothing and is kept; vectors of different lengths do not link; a null vec_id takes part but never names a
component; repeated rows are vectors of their own; an empty table gives an empty table.  Ids are integers, or text of
them; other text is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, opened, ship
from .components import connected

BLOCK = 4096
TILE = 512
#: Leading dimensions of the first step, and of the boxes.
LEAD = 16
#: Vectors of the sample on which axes and tree are fitted.
SAMPLE = 20_000
#: Leaves of the tree at most, so the boxes stay small; a leaf is dealt into as many blocks as it needs.
MAX_LEAVES = 1 << 13
#: Tasks of the comparison at most; with more pairs of blocks a task takes several in turn.
MAX_TASKS = 10_000


def valid(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray, d: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten())


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Rows are the axes of unit vectors, the strongest first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].T.copy()


def _splits(sample: np.ndarray, parts: int) -> list:
    """A tree of median splits along the axis of widest spread: (axis, value, left, right) or a leaf."""
    if parts <= 1 or len(sample) < 2:
        return []
    axis = int(np.argmax(sample.std(0)))
    value = float(np.median(sample[:, axis]))
    low = sample[:, axis] < value
    if low.all() or not low.any():
        return []
    return [axis, value, _splits(sample[low], parts // 2), _splits(sample[~low], parts // 2)]


def _leaf(y: np.ndarray, tree: list, first: int = 1) -> np.ndarray:
    out = np.full(len(y), first, np.int64)
    if tree:
        low = y[:, tree[0]] < tree[1]
        out[low] = _leaf(y[low], tree[2], 2 * first)
        out[~low] = _leaf(y[~low], tree[3], 2 * first + 1)
    return out


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, smallest node that the links between a and b lead to) where they differ."""
    big = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], big).min(1))
        nb = np.minimum(lb, np.where(near, na[:, None], big).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    for node, label in ((a, la), (b, lb)):
        moved = node != label
        if moved.any():
            yield node[moved], label[moved]


class _Tiles:
    def __init__(self, ids: np.ndarray, mult: np.ndarray, x: np.ndarray, axes: np.ndarray):
        y = x @ axes.T
        order = np.lexsort((ids, y[:, 1 % y.shape[1]], y[:, 0]))
        self.ids, self.mult, self.x, self.y = ids[order], mult[order], x[order], y[order]
        d = y.shape[1]
        self.k = min(LEAD, d)
        self.steps = [*[k for k in (LEAD << i for i in range(d.bit_length())) if k < d], d]
        left = 1 - np.cumsum(self.y**2, 1)[:, [k - 1 for k in self.steps]]
        self.suffixes = np.sqrt(np.maximum(0, left)) + 1e-12  # a column for each step
        self.suffix = self.suffixes[:, 0]
        self.cuts = [(s, min(s + TILE, len(ids))) for s in range(0, len(ids), TILE)]
        self.boxes = [(self.y[s:e, : self.k].min(0), self.y[s:e, : self.k].max(0), self.suffix[s:e].max()) for s, e in self.cuts]


def _reach(p: tuple, q: tuple) -> float:
    """Upper bound of a cosine between two boxes (low, high, suffix norm).  Two unit vectors' leading parts
    are at least the boxes' gap apart, and 2 - 2 cos is their squared distance; products bound it too."""
    gap = np.maximum(0, np.maximum(p[0] - q[1], q[0] - p[1]))
    corners = np.max([p[0] * q[0], p[0] * q[1], p[1] * q[0], p[1] * q[1]], 0)
    return min(1 - (gap * gap).sum() / 2, corners.sum() + p[2] * q[2])


def _near(p: _Tiles, s: tuple[int, int], q: _Tiles, t: tuple[int, int], threshold: float) -> np.ndarray | None:
    a, b = p.y[s[0] : s[1]], q.y[t[0] : t[1]]
    cos, done = np.zeros((len(a), len(b))), 0
    for n, k in enumerate(p.steps):
        cos += a[:, done:k] @ b[:, done:k].T
        done = k
        can = cos + p.suffixes[s[0] : s[1], n, None] * q.suffixes[None, t[0] : t[1], n] >= threshold - 1e-9
        if not can.any():
            return None
        if can.mean() < 0.1:
            break
    i, j = np.nonzero(can)
    if done < a.shape[1]:
        for c in range(0, len(i), 1 << 16):
            ii, jj = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            cos[ii, jj] += np.einsum("nd,nd->n", a[ii, done:], b[jj, done:])
    near = can & (cos >= threshold)
    i, j = np.nonzero(can & (np.abs(cos - threshold) < 1e-9))
    if len(i):
        near[i, j] = np.einsum("nd,nd->n", p.x[s[0] + i], q.x[t[0] + j]) >= threshold
    return near if near.any() else None


def _compare(p: _Tiles, q: _Tiles, same: bool, threshold: float) -> tuple[dict, list]:
    counts, edges = {}, []
    own = np.zeros(len(p.ids), np.int64)
    other = own if same else np.zeros(len(q.ids), np.int64)
    for m, s in enumerate(p.cuts):
        for n, t in enumerate(q.cuts):
            if (same and n < m) or _reach(p.boxes[m], q.boxes[n]) < threshold - 1e-9:
                continue
            near = _near(p, s, q, t, threshold)
            if near is None:
                continue
            edges += _forest(near, p.ids[s[0] : s[1]], q.ids[t[0] : t[1]])
            if same and m == n:
                np.fill_diagonal(near, False)
            own[s[0] : s[1]] += near @ q.mult[t[0] : t[1]]
            if not (same and m == n):
                other[t[0] : t[1]] += p.mult[s[0] : s[1]] @ near
    for tiles, found in ((p, own),) if same else ((p, own), (q, other)):
        counts |= dict(zip(tiles.ids[found > 0].tolist(), found[found > 0].tolist(), strict=True))
    return counts, edges


def _links(reps: DataFrame, d: int, threshold: float, scratch: Scratch) -> DataFrame:
    """kind c: (a, n), n links of representative a; kind e: an edge (a, n) between representatives."""
    reps = reps.where(F.size("v") == d)
    total, k = reps.count(), min(LEAD, d)
    sample = _unit(_flat(reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()), d)
    axes = principal_axes(sample)
    tree = _splits(sample @ axes[:k].T, min(MAX_LEAVES, 1 << max(0, (-(-total // BLOCK) - 1).bit_length())))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _unit(_flat(batch.column(2)), d) @ axes[:k].T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_leaf(y, tree)), pa.array(list(y), pa.list_(pa.float64()))], names=["rep", "m", "v", "leaf", "y"])

    ship(reps.sparkSession)
    placed = scratch.cut(reps.select("rep", "m", "v").mapInArrow(assign, f"rep long, m long, v {reps.schema['v'].dataType.simpleString()}, leaf long, y array<double>"))
    lead = [F.element_at("y", i + 1) for i in range(k)]
    norm = F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate("y", F.lit(0.0), lambda t, x: t + x * x)))
    leaves = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("c"), F.array(*[F.min(c) for c in lead]).alias("lo"), F.array(*[F.max(c) for c in lead]).alias("hi"), F.max(norm).alias("s")
    ).withColumn("parts", F.ceil(F.col("c") / BLOCK)).orderBy("leaf").toPandas()
    names, parts = leaves["leaf"].to_numpy(np.int64), leaves["parts"].to_numpy(np.int64)
    lo, hi, suffix = np.array(leaves["lo"].tolist()), np.array(leaves["hi"].tolist()), leaves["s"].to_numpy() + 1e-12

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of leaves whose boxes can reach the threshold, with the numbers of their blocks."""
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gap = np.maximum(0, np.maximum(lo[i] - hi, lo - hi[i]))
                corners = np.max([lo[i] * lo, lo[i] * hi, hi[i] * lo, hi[i] * hi], 0).sum(1) + suffix[i] * suffix
                fits = np.flatnonzero(np.minimum(1 - (gap * gap).sum(1) / 2, corners) >= threshold - 1e-9)
                fits = fits[fits >= i]
                columns = np.full(len(fits), names[i]), names[fits], np.full(len(fits), parts[i]), parts[fits]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["p", "q", "np", "nq"])

    spark, root = reps.sparkSession, f"{scratch.root}/blocks-{d}"
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = spark.range(0, len(names), 1, max(1, min(len(names), 200))).mapInArrow(partners, "p long, q long, np long, nq long")
    pairs = pairs.withColumn("i", number("np")).withColumn("j", number("nq")).where("p < q or i <= j")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for each block; a task that runs again writes others, and only what it returns is read."""
        at, folder = opened(root)
        at.create_dir(folder, recursive=True)

        def written(key: tuple, held: list) -> pa.RecordBatch:
            name = f"{key[0]}-{key[1]}-{uuid.uuid4().hex}.arrow"
            with at.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_file(out, held[0].schema) as writer:
                for x in held:
                    writer.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([f"{root}/{name}"])], names=["leaf", "part", "path"])

        now, held = None, []
        for batch in batches:
            leaf, part = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            cuts = [0, *(np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(batch)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held and now != (int(leaf[s]), int(part[s])):
                    yield written(now, held)
                    held = []
                now = int(leaf[s]), int(part[s])
                held.append(batch.slice(s, e - s).select(["rep", "m", "v"]))
        if held:
            yield written(now, held)

    sizes = spark.createDataFrame(pd.DataFrame({"leaf": names, "parts": parts}))  # MAX_LEAVES rows at most
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")
    dealt = placed.drop("y").join(F.broadcast(sizes), "leaf").select("rep", "m", "v", "leaf", part).repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    files = scratch.cut(dealt.mapInArrow(store, "leaf long, part long, path string"))
    of = lambda leaf, part, name: files.select(F.col("leaf").alias(leaf), F.col("part").alias(part), F.col("path").alias(name))
    work = scratch.cut(pairs.join(of("p", "i", "first"), ["p", "i"]).join(of("q", "j", "second"), ["q", "j"]).select("first", "second"))

    def tiles(path: str) -> _Tiles:
        at, name = opened(path)
        with at.open_input_file(name) as f:
            t = pa.ipc.open_file(f).read_all()
        return _Tiles(t.column("rep").to_numpy(), t.column("m").to_numpy(), _unit(_flat(t.column("v").combine_chunks()), d), axes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = "", None
        for batch in batches:
            for p, q in zip(*[batch.column(c).to_pylist() for c in (0, 1)], strict=True):
                held = held if held[0] == p else (p, tiles(p))
                first = held[1]
                counts, edges = _compare(first, first if p == q else tiles(q), p == q, threshold)
                a = np.concatenate([np.fromiter(counts, np.int64, len(counts)), *[e[0] for e in edges]])
                b = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)), *[e[1] for e in edges]])
                kind = ["c"] * len(counts) + ["e"] * (len(a) - len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a), pa.array(b)], names=["kind", "a", "n"])

    # As many tasks as pairs, up to a bound: the rows are small and the work is not, so their number is set.
    return work.repartition(max(1, min(MAX_TASKS, work.count())), "first", "second").sortWithinPartitions("first").mapInArrow(compare, "kind string, a long, n long")


def groups(df: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", name: str = "embeddings") -> DataFrame:
    """vec_id, ``n_links``, ``component_id`` and ``kept`` of every row."""
    scratch = Scratch(df.sparkSession, name)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.withColumn("v", F.when(valid(F.col("v")), F.col("v")))
    # Copies are one representative; the table is written before its numbers are used, so they stay.
    reps = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"))
    reps = scratch.cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    lengths = [r["d"] for r in reps.select(F.size("v").alias("d")).distinct().collect()]
    found = None
    for d in lengths:
        part = _links(reps, d, threshold, scratch)
        found = part if found is None else found.union(part)
    alone = F.struct(F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        return rows.select(alone.alias("x")).select("x.*").withColumn("kept", F.lit(True))
    found = scratch.cut(found)
    roots = connected(found.where("kind = 'e'").select("a", F.col("n").alias("b")), scratch)
    counts = found.where("kind = 'c'").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    nodes = reps.drop("v").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    firsts = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(firsts, "root").join(counts, "rep", "left")
    named = named.select("rep", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"))
    keyed = reps.select("v", "rep").join(named, "rep").drop("rep")
    linked = rows.join(keyed, "v", "left")
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))
