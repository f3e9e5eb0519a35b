"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the point frac(i * golden ratio); the cumulative target shares map it to a source.
Slots are ranked per source, and the slot of rank r takes the r-th block of ``block`` words of the source's
stream: its documents in a shuffled order, repeated from the start when it ends.  A source that has its
target takes no more slots and the last block is cut to the target; slots that the schedule leaves short
(a source with a tiny share) are appended.  So what each source gives is its target to the word.

Targets share ``budget`` times all words by weight, but none is above ``epochs`` times its source's words;
what that leaves over is shared again by weight.

Ranks and stream positions are running totals over a fixed number of buckets per source
(``common.running``), so no task holds a source.  Texts are read once, for their sizes.

Defined results: a null text has size 0; a document of size 0 is taken 0 times; the null source is a source,
and comes last; repeated rows are documents of their own, and so are rows that share a doc_id; an empty table
gives an empty table.  The shuffle is by a hash of doc_id, text and the seed: reruns agree whatever the
partitions (rows of equal doc_id, text and source are interchangeable).  Sources are a table of one row each,
which one task orders; rows, blocks and slots never meet in one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, WORD, Scratch, consumed, fresh, null_safe, row_keys, running

#: Words of a block.
BLOCK = 256
#: 2^31 over the golden ratio, odd: multiples of it modulo 2^31 fill the circle evenly.
GOLDEN = 1327217885
CIRCLE = 1 << 31
#: Buckets of a source's documents and of the slots.
BUCKETS = 2048
#: Cells of the circle by which slots find their source.
CELLS = 1024


@dataclass(frozen=True)
class Mix:
    documents: DataFrame  # doc_id, source, size, source_size, target, taken (and the row's hashes, in ``apply``)
    schedule: DataFrame  # slot, doc_id, source, first_word, n_words: what the mix reads, in order
    sources: DataFrame  # source, source_size, target


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """source, source_size, n, target.  ``totals``: source, source_size, one row per source.

    Sharing the excess again and again ends at one level: target = min(epochs * size, level * weight).
    Ordered by epochs * size / weight, the sources at their limit come first, so the level is found by
    running sums over the table of sources.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    n = F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int")
    weighed = totals.withColumn("n", F.row_number().over(by_code)).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), n + 1),
        "cap": F.col("source_size") * F.lit(float(epochs)),
    })
    whole = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    leveled = weighed.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget))).withColumn("level", level)
    # The first source whose limit is above its level sets the level of all after it.
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("level")))).over(whole)
    return leveled.withColumn("free", free).select(
        "source", "source_size", "n", F.least("cap", F.coalesce(F.col("free.level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _described(df: DataFrame, text: str, source: str, doc_id: str, seed: int) -> list[Column]:
    """What the mix reads of a row."""
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("_key")]


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0, block: int = BLOCK, seed: int = 42,
        text: str = "text", source: str = "source", doc_id: str = "doc_id", name: str = "mixing") -> Mix:
    return _mix(df.select(*_described(df, text, source, doc_id, seed)), [], weights, budget, epochs, block, Scratch(df.sparkSession, name))


def _mix(docs: DataFrame, row: list[str], weights: tuple[float, ...], budget: float, epochs: float, block: int, scratch: Scratch) -> Mix:
    """``docs``: doc_id, source, size, _key and the columns ``row``, which tell rows apart that share all of these."""
    bucket = F.pmod(F.xxhash64("_key", F.lit(0)), F.lit(BUCKETS))
    docs = scratch.cut(docs.withColumn("_bucket", bucket.cast("long")))
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = scratch.cut(targets(totals, weights, budget, epochs))

    # Where each document begins in its source's stream.
    offsets = running(docs, ["source"], "_bucket", [("size", "_offset", "sum")])
    within = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *row).rowsBetween(W.unboundedPreceding, -1)
    streamed = null_safe(docs, offsets, ["source", "_bucket"]).withColumn("start", F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    streamed = null_safe(streamed, sources, ["source"]).select("doc_id", "n", "source", "size", "source_size", "target", "start", *row)
    streamed = scratch.cut(streamed)

    slots = _slots(sources, scratch, block)
    span = F.col("source_size")
    last_end = F.floor("target").cast("long")
    blocks = streamed.where("size > 0").withColumn("_at", F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(max(0, int(-(-epochs // 1)) - 1))), lambda e: F.col("start") + e * span), lambda a: a < last_end
    ))).withColumn("_end", F.least(F.col("_at") + F.col("size"), last_end))
    b = F.lit(block).cast("long")
    blocks = blocks.withColumn("rank", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_end - 1) div {block}"))))
    first = F.greatest("_at", F.col("rank") * b)
    taken = blocks.withColumns({"first_word": first - F.col("_at"), "n_words": F.least(F.col("_end"), (F.col("rank") + 1) * b) - first})
    schedule = taken.join(slots, ["n", "rank"]).select("slot", "doc_id", "source", "n", "start", "first_word", "n_words")
    counts = schedule.groupBy("n", "start").agg(F.sum("n_words").alias("taken"))
    sized = streamed.withColumn("_start", F.when(F.col("size") > 0, F.col("start")))
    documents = sized.join(counts.withColumnRenamed("start", "_start"), ["n", "_start"], "left")
    documents = documents.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *row)
    return Mix(documents, schedule.select("slot", "doc_id", "source", "first_word", "n_words"), sources)


def apply(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0, block: int = BLOCK, seed: int = 42,
          text: str = "text", source: str = "source", doc_id: str = "doc_id", name: str = "mixing") -> DataFrame:
    """The mix as rows of the input: a document as often as the mix takes it whole, and once more with its
    first words (joined by a space) if the target ends inside it.

    Rows are known by a hash of all their columns, so only that, sizes and sources are written before the mix; the
    input is joined once, at the end.  Rows that are equal in all columns give their copies from one of them.
    """
    scratch = Scratch(df.sparkSession, f"{name}-taken")
    one, two, whole, part, first = fresh(df, "_k1", "_k2", "_whole", "_part", "_is_whole")
    with consumed():
        described = df.select(*_described(df, text, source, doc_id, seed), *[k.alias(c) for k, c in zip(row_keys(df), ("_k1", "_k2"), strict=True)])
        taken = _mix(described, ["_k1", "_k2"], weights, budget, epochs, block, Scratch(df.sparkSession, name)).documents.where("taken > 0")
        sums = taken.groupBy("_k1", "_k2").agg(F.expr("cast(sum(taken div size) as int)").alias(whole), F.expr("cast(sum(taken % size) as int)").alias(part))
        sums = scratch.cut(sums.withColumnsRenamed({"_k1": one, "_k2": two}))
    keyed = df.withColumns(dict(zip((one, two), row_keys(df), strict=True)))
    joined = keyed.join(sums.hint("merge"), [one, two]).dropDuplicates([one, two])
    words = F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda w: w != ""), 1, F.col(part)), " ")
    copies = F.concat(F.array_repeat(F.lit(True), F.col(whole)), F.when(F.col(part) > 0, F.array(F.lit(False))).otherwise(F.expr("cast(array() as array<boolean>)")))
    mixed = joined.withColumn(first, F.explode(copies))
    return mixed.withColumn(text, F.when(F.col(first), F.col(text)).otherwise(words)).select(*[F.col(f"`{c}`") for c in df.columns])


def _slots(sources: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """n, rank, slot: for every source as many ranks as its target has blocks."""
    spark = scratch.spark
    order = W.orderBy("n")
    total = F.sum("target").over(W.partitionBy())
    upto = lambda frame: F.round(F.coalesce(F.sum("target").over(frame), F.lit(0.0)) / F.when(total > 0, total) * CIRCLE).cast("long")
    arcs = sources.withColumns({
        "lo": upto(order.rowsBetween(W.unboundedPreceding, -1)),
        "hi": upto(order.rowsBetween(W.unboundedPreceding, 0)),
        "need": F.ceil(F.col("target").cast("long") / block).cast("long"),
    }).select("n", "lo", "hi", "need")
    arcs = scratch.cut(arcs)
    count = arcs.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    width = CIRCLE // CELLS
    cells = arcs.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    ids = spark.range(count).withColumn("u", F.pmod(F.pmod("id", F.lit(CIRCLE)) * F.lit(GOLDEN).cast("long"), F.lit(CIRCLE).cast("long")))
    ids = ids.withColumn("cell", F.expr(f"u div {width}"))
    placed = ids.join(cells, "cell").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "n", "need")
    per = max(1, -(-count // BUCKETS))
    placed = scratch.cut(placed.withColumn("_part", F.expr(f"slot div {per}")))
    offsets = running(placed.withColumn("_one", F.lit(1)), ["n"], "_part", [("_one", "_offset", "sum")])
    within = W.partitionBy("n", "_part").orderBy("slot")
    ranked = placed.join(offsets, ["n", "_part"]).withColumn("rank", F.col("_offset") + F.row_number().over(within) - 1)
    ranked = ranked.where("rank < need").select("n", "rank", "slot")
    given = placed.groupBy("n").agg(F.count(F.lit(1)).alias("given"))
    short = arcs.join(given, "n", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < need")
    # The appended slots are numbered on, source after source.
    lacking = short.withColumn("at", count - F.col("given") + F.coalesce(F.sum(F.col("need") - F.col("given")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    extra = lacking.select("n", "at", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
    extra = extra.select("n", "rank", (F.col("at") + F.col("rank")).cast("long").alias("slot"))
    return ranked.unionByName(extra)
