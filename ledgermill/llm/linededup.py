"""Line dedup over overlapping windows of three lines.

Windows are three consecutive lines that hold a word (blank lines between them belong to the window).  A
window whose lines occur earlier, in document order (doc_id, then position), is a repeat, and every line that
a repeat covers goes.  A line's earliest occurrence is never inside a repeat, so no distinct line is lost
from the corpus, and documents of fewer than three such lines never change.

Hashes are 128 bits.  One aggregation finds each repeated window's first place; the join with it has one row
per repeated window on its small side, so a window that a third of all documents share is only a hot key on
the large side, which adaptive execution splits.  Both small sides grow with the corpus, so neither is broadcast.

Defined results: a null text stays null, with no lines; an empty text has one blank line; repeated rows (same
doc_id and text) are one document and change alike; a null doc_id comes last in document order; other columns
are passed on, and ones named ``n_lines`` or ``n_removed`` give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, Scratch, fresh, null_safe


def _windows(text: Column) -> Column:
    """Structs s, e (the first and last line's positions) and h1, h2 (the hash) of a text's windows."""
    held = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(WORD))

    def slide(lines: Column) -> Column:
        at = lambda i, k: F.get(lines, i + k)
        one = lambda i: F.struct(
            at(i, 0)["i"].alias("s"), at(i, 2)["i"].alias("e"),
            F.xxhash64(*[at(i, k)["x"] for k in (0, 1, 2)]).alias("h1"), F.xxhash64(*[at(i, k)["x"] for k in (2, 0, 1)], F.lit(1)).alias("h2"),
        )
        return F.when(F.size(lines) >= 3, F.transform(F.sequence(F.lit(0), F.size(lines) - 3), one))

    return F.get(F.transform(F.array(held), lambda x: slide(x)), F.lit(0))


def _kept(text: Column, covers: Column) -> Column:
    """The text without the lines inside ``covers`` (structs s, e; their ends grow with their starts)."""
    def cut(c: Column, lines: Column) -> Column:
        gaps = F.transform(c, lambda x, k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(c, k - 1)["e"] + 1).alias("a"), x["s"].alias("b")))
        gaps = F.concat(gaps, F.array(F.struct((F.element_at(c, -1)["e"] + 1).alias("a"), F.size(lines).alias("b"))))
        return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0)))))

    bound = F.transform(F.array(F.struct(F.sort_array(covers).alias("c"), F.split(text, "\n").alias("l"))), lambda x: cut(x["c"], x["l"]))
    return F.get(bound, F.lit(0))


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", name: str = "linededup") -> DataFrame:
    """The input with ``text`` rid of repeats, ``n_lines`` (before) and ``n_removed``."""
    scratch = Scratch(df.sparkSession, name)
    place = lambda s: F.struct(F.col("d").isNull().alias("x"), "d", F.col("t"), F.col(s).alias("s"))
    docs = df.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("_text"))
    windows = docs.select("d", "t", F.explode(_windows(F.col("_text"))).alias("w")).select("d", "t", "w.*")
    windows = scratch.cut(windows)
    firsts = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place("s")).alias("first")).where("n > 1").drop("n")
    later = windows.join(firsts.hint("merge"), ["h1", "h2"]).where(place("s") > F.col("first"))
    covers = later.groupBy("d", "t").agg(F.collect_set(F.struct("s", "e")).alias("_covers"))
    covers = scratch.settle(covers)
    one, two, held, left = fresh(df.withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)}), "_d", "_t", "_covers", "_kept")
    covers = covers.withColumnsRenamed({"d": one, "t": two, "_covers": held})
    joined = null_safe(df.withColumns({one: F.col(doc_id), two: F.xxhash64(text)}), covers.hint("merge"), [one, two], "left").drop(one, two)
    kept = F.when(F.col(held).isNotNull(), _kept(F.col(text), F.col(held)))
    n_lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(0))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(n_lines).cast("long")
    found = joined.withColumn(left, kept).withColumns({
        "n_lines": n_lines,
        "n_removed": F.coalesce(n_lines - F.size(left), F.lit(0)).cast("long"),
        text: F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text)),
    })
    return found.drop(held, left)
