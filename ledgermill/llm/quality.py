"""Rule-based quality filter: a table of thresholds compiled into one projection of built-in expressions.

Defined results: a null or empty text has no words, so every count is 0, every ratio is 0 and it fails the
``n_words`` rule; rows repeated in the input are judged separately and alike; an empty table gives an empty
table; other columns of the input are passed on, and the operator's own columns replace any of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let as _let
from .common import SPACE, WORD, fresh

#: Frequent short words of the four languages of the corpus: fixed values.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with by be this from or an at not have a",
    "fr": "le la les de des du et un une en que qui est dans pour pas sur au il elle ce aux",
    "de": "der die das und ist von den mit zu ein eine dem des auf für im nicht sich als auch",
    "es": "el la los las de y que en un una es por con para se del al lo no su",
}


@dataclass(frozen=True)
class Rule:
    """A document is kept if ``low <= metric <= high`` (an end that is None is open).  ``min_words``: texts
    with fewer words are not held to the rule, since a ratio over a few words says little."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table.  Ratios are per word or per line that has a word.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02, min_words=50),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("repetition", "repeat_word_ratio", high=0.5),
)


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of word positions inside windows of ``width`` words that occur twice or more, the first
    occurrence included.

    Windows are sorted as pairs of their 64-bit hash and their position, so equal windows are neighbours whatever
    the length of the text; the positions of those with an equal neighbour are sorted again, and each covers up to
    the next: n log n for a text of n words, without leaving the projection.
    """
    n = F.size(words) - width + 1

    def starts(ordered: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == F.get(ordered, y)["h"], F.lit(False))
        repeated = F.filter(ordered, lambda x, j: same(x, j + 1) | same(x, j - 1))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    gaps = lambda s: F.transform(s, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - p, F.lit(width))))
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("i")))
    covered = F.aggregate(_let(_let(F.sort_array(windows), starts), gaps), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n >= 2, covered).otherwise(F.lit(0).cast("long"))


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and the ratios that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({x for ws in STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())})
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        repeated_window_words(w).alias("repeated"),
        F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("stop"),
        F.length(F.array_join(w, "")).cast("long").alias("chars"),
    ))
    word_lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    of_lines = _let(word_lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    own, lines = fresh(df, "_words", "_lines")
    counted = df.withColumns({own: of_words, lines: of_lines}).withColumns({
        "n_words": F.col(own)["n"],
        "word_chars": F.col(own)["chars"],
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.col(lines)["n"],
        "n_dup_lines": F.col(lines)["dup"],
        "n_repeat_words": F.col(own)["repeated"],
        "n_stop_words": F.col(own)["stop"],
    }).drop(own, lines)
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.withColumns({
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    })


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row with metrics breaks, as an array."""
    def broken(r: Rule) -> Column:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        return F.when(bad & (F.col("n_words") >= r.min_words), F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input with its metrics, ``failed_rules`` and ``kept``."""
    return with_metrics(df, text).withColumn("failed_rules", verdict(rules)).withColumn("kept", F.size("failed_rules") == 0)
