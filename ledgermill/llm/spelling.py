"""Spelling variants: words that differ by one inserted, deleted or replaced character, found by permuterm rotations.

A word is marked with a terminator and turned so that the edited character stands last: ``b$a`` is what the word
``a c b`` leaves of its rotation ``b$ac`` when that character is skipped, and it is the whole rotation of ``ab``.
Sorted, a rotation is followed by those it is the prefix of, so a group of equal ``b$a`` holds the words that differ
in that one place alone: by another character, or by none.  Its members differ in one character, so a group has no
more of them than the alphabet has characters, and one.  Groups are scanned by windows: each member learns how many
near words the group shows it, and the best of them, which is the group's first or second by count; pairs are not
made.  A word of a doubled letter gives the same word whichever of the two is deleted; only the first counts, so that
every pair of near words is counted in one group.

Up to ``LONG`` characters ``b$a`` is text.  Beyond that, where the rotations of a word would grow with the square
of its length, it is named by its length, its place and 124 bits of polynomial hashes, which take time in proportion
to the length; such words go by a name of their first characters and their rank, which sorts as they do.

A word's form is its near word of the largest count (ties: the smallest by code points) if that is at least
``ratio`` times its own.  Counts grow along forms, so following them ends; it is done by doubling.

Defined results: null and empty texts have no words; a null id counts as the empty string where a character is dropped;
repeated rows count each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Scratch, lean, ship

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a rotation that is kept as text.
LONG = 64
#: Prime moduli below 2^31 and the bases of the hashes.
FIELDS = ((2147483647, 1103515245), (2147483629, 1664525), (2147483587, 22695477), (2147483579, 69069))


def words(df: DataFrame, noise: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word`` of every occurrence, A-Z lower-cased.  With ``noise`` one in so many (by the crc32 of id and run) loses
    a character, as a test of what the grouping finds."""
    runs = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("word"))
    if noise is None:
        return runs.select("word")
    hashed = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "word")))
    at = F.pmod("h", F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(F.when(F.pmod("h", F.lit(noise)) == 0, less).otherwise(F.col("word")).alias("word"))


def _rotations(word: Column, length: Column) -> Column:
    """Structs key, full, first: whether the key is a whole rotation, and whether the skipped character begins a run."""
    turned = lambda after, before: F.concat(F.substring(word, after + 1, length), F.lit("$"), F.substring(word, F.lit(1), before))
    skip = lambda i: F.struct(
        turned(i, i - 1).alias("key"), F.lit(False).alias("full"), ((i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1)))).alias("first")
    )
    full = lambda i: F.struct(turned(i, i).alias("key"), F.lit(True).alias("full"), F.lit(False).alias("first"))
    skips = F.transform(F.sequence(F.lit(1), length), skip)
    return F.when(length < LONG, F.concat(skips, F.transform(F.sequence(F.lit(0), length), full))).when(length == LONG, skips)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    found, step = np.ones(n, np.uint64), 1
    while step < n:
        more = found[step : 2 * step]
        more[:] = found[: len(more)] * np.uint64(pow(base, step, p)) % np.uint64(p)
        step *= 2
    return found


def hashed_rotations(word: str, longest: int) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """(keys, full, first) of a word's rotations that are no text, being longer than ``longest``: rows of length,
    place and hashes of what stands around the place."""
    x = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(x)
    whole, skipped = np.empty((n + 1, 6), np.int64), np.empty((n, 6), np.int64)
    whole[:, 0], whole[:, 1] = n + 1, np.arange(n + 1)
    skipped[:, 0], skipped[:, 1] = n, np.arange(n)
    for k, (p, base) in enumerate(FIELDS):
        q = np.uint64(p)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(base, p, n) % q) % q])
        rest = (upto[n] + q - upto[1:]) % q * np.uint64(pow(base, -1, p)) % q  # moved by one place
        whole[:, 2 + k], skipped[:, 2 + k] = upto[n], (upto[:n] + rest) % q
    if n >= longest:
        yield whole, True, np.zeros(n + 1, bool)
    if n > longest:
        yield skipped, False, np.concatenate([np.ones(1, bool), x[1:] != x[:-1]])


def _long_rotations(long: DataFrame) -> DataFrame:
    """name, n, key, full, first of words whose rotations are hashed; ``long``: word, name, n."""
    names, longest = ["name", "n", "key", "full", "first"], LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                for word, name, n in zip(*batch.columns, strict=True):
                    for keys, full, first in hashed_rotations(word.as_py(), longest):
                        for at in range(0, len(keys), 10_000):
                            part = pa.array(["#" + ":".join(map(str, k)) for k in keys[at : at + 10_000].tolist()])
                            same = [pa.array([v] * len(part), kind) for v, kind in ((name.as_py(), pa.string()), (n.as_py(), pa.int64()), (full, pa.bool_()))]
                            yield pa.RecordBatch.from_arrays([same[0], same[1], part, same[2], pa.array(first[at : at + 10_000])], names=names)

    ship(long.sparkSession)
    return long.select("word", "name", "n").mapInArrow(run, "name string, n long, key string, full boolean, first boolean")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """name, n_near and best (the near word's count and name) of words with near ones; ``vocabulary``: word, name, n."""
    length = F.length("word")
    turned = vocabulary.where(length <= LONG).select("name", "n", F.explode(_rotations(F.col("word"), length)).alias("r")).select("name", "n", "r.*")
    turned = turned.unionByName(_long_rotations(vocabulary.where(length >= LONG)))
    group = W.partitionBy("key").orderBy(F.desc("n"), "name").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("minus"), F.col("name").alias("name"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(group)
    seen = turned.withColumns({
        "one": F.first(member).over(group), "two": F.nth_value(member, 2).over(group),
        "skips": count(~F.col("full")), "firsts": count(F.col("first")), "wholes": count(F.col("full")),
    }).where(F.col("two").isNotNull())
    near = F.when(F.col("full"), F.col("firsts")).otherwise(F.col("skips") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0))
    best = F.when(F.col("one.name") == F.col("name"), F.col("two")).otherwise(F.col("one"))
    return seen.select("name", near.alias("near"), best.alias("best")).groupBy("name").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """name, root of the rows name, form: where following forms ends."""
    now = scratch.cut(formed.select("name", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("name").alias("root"), F.col("root").alias("next"))
        moved = scratch.cut(now.join(on, "root", "left").select("name", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = moved.drop("moved")
        now._scratch_path = moved._scratch_path
        if not moved.where("moved").limit(1).count():
            return now


def group(df: DataFrame, ratio: float = 2, shortest: int = 5, least: int = 3, noise: int | None = None, text: str = "text", doc_id: str = "doc_id", name: str = "spelling") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``shortest`` characters and ``least``
    occurrences."""
    scratch = Scratch(df.sparkSession, name)
    counted = words(df, noise, text, doc_id).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    counted = scratch.cut(counted)
    is_long = F.length("word") > LONG
    # Sorted, partitions follow each other, so the ids rise with the words.
    ranked = scratch.cut(counted.where(is_long).orderBy("word").withColumn("rank", F.monotonically_increasing_id()))
    long = ranked.select("word", F.concat(F.substring("word", 1, LONG), F.lit("#"), F.lpad(F.col("rank").cast("string"), 20, "0")).alias("name"), "n")
    vocabulary = counted.where(~is_long).select("word", F.col("word").alias("name"), "n").unionByName(long)
    near = scratch.cut(neighbours(vocabulary))
    described = vocabulary.drop("word").join(near, "name", "left").withColumn("form_n", -F.col("best.minus"))
    forms = F.when(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.col("best.name"))
    described = described.select("name", forms.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(forms.isNotNull(), F.col("form_n")).alias("form_n"))
    described = scratch.cut(described)
    found = described.join(_roots(described.where("form is not null"), scratch), "name", "left").withColumn("root", F.coalesce("root", "name"))
    # Names of long words become the words again: those of words that are long themselves or near one.
    columns = ["name", "form", "root"]
    named = F.array_contains(F.transform(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), lambda x: F.contains(x, F.lit("#"))), F.lit(True))
    plain, far = found.where(~named), found.where(named)
    for c in columns:
        far = far.join(long.select(F.col("name").alias(c), F.col("word").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w")
    return plain.unionByName(far).select(F.col("name").alias("word"), "form", "root", "n", "n_near", "form_n")
