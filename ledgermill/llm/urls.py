"""URL filter on a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 takes for listed though they are
not; level 2 the listed keys that level 1 takes for such; and so on until a level errs on nothing.  The key
universe of the corpus is complete, so membership is exact for every key that is ever asked, with no join:
the levels are byte strings inside one projection.

The filters' size follows the list and not the corpus: level 0 has a false positive rate of about
listed / universe, and the later levels halve.  Once a later level errs on ``FEW`` keys or less, these are named
instead of encoded, which ends the cascade.  A list whose cascade would pass ``MAX_FILTER_BYTES`` is dealt by a
hash of the key into parts that each stay below it; the pages are judged part after part, and the best fitting
rule of all parts wins, so the bound on what a task carries costs passes and never exactness.

Keys are host followed by path prefix.  A url's candidates are the suffixes of its host with as many labels, each
with the prefix of its path of as many characters, as some rule has of both.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; null rules
are ignored; a key listed for both actions blocks; the longest fitting rule wins, of two equally long ones
that with the longer host; repeated pages are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let as _let
from .common import Scratch, fresh

#: Bound on all levels of one cascade, which every task carries.
MAX_FILTER_BYTES = 64 << 20
#: Keys that a cascade names at its end, at most.
FEW = 200


@dataclass(frozen=True)
class Bloom:
    level: int
    bits: int
    hashes: int
    data: bytes = b""

    def positions(self, key: Column) -> Column:
        """The key's bits, an array of longs."""
        mod = F.lit(self.bits).cast("long")
        first, step = (F.pmod(F.xxhash64(key, F.lit(2 * self.level + i)), mod) for i in (0, 1))
        steps = F.sequence(F.lit(0).cast("long"), F.lit(self.hashes - 1).cast("long"))
        return _let(F.struct(first.alias("a"), step.alias("b")), lambda s: F.transform(steps, lambda i: F.pmod(s["a"] + i * s["b"], mod)))

    def might_hold(self, key: Column) -> Column:
        byte = lambda p: F.conv(F.hex(F.substring(F.lit(self.data), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.forall(self.positions(key), lambda p: F.getbit(byte(p), F.pmod(p, F.lit(8)).cast("int")) == 1)


def level_bits(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a level of n keys."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, 8 * math.ceil(n * hashes / math.log(2) / 8)), hashes


def encode(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """A filter of ``keys.key``, set by one aggregation per byte; one byte string reaches the driver."""
    bits, hashes = level_bits(n, rate)
    empty = Bloom(level, bits, hashes)
    where = keys.select(F.explode(empty.positions(F.col("key"))).alias("p"))
    set_ = where.groupBy(F.floor(F.col("p") / 8).alias("b")).agg(F.bit_or(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod("p", F.lit(8)).cast("int") + 1)).alias("v"))
    zero = keys.sparkSession.range(bits // 8).select(F.col("id").alias("b"), F.lit(0).alias("v"))
    whole = set_.unionByName(zero).groupBy("b").agg(F.max("v").alias("v"))
    # Bytes meet in parts of bounded length, then the parts in one string of at most MAX_FILTER_BYTES.
    parts = whole.groupBy(F.floor(F.col("b") / 8192).alias("g")).agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("x"))
    parts = parts.select("g", F.array_join(F.transform("x", lambda s: F.lpad(F.hex(s["v"]), 2, "0")), "").alias("h"))
    data = parts.agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda s: s["h"]), "")).alias("d")).first()["d"]
    return Bloom(level, bits, hashes, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]
    named: tuple[str, ...] = ()  # what the last level takes wrongly

    def contains(self, key: Column) -> Column:
        n = len(self.levels)
        found = F.lit(n % 2 == 1)
        if self.named:
            wrong = key.isin(*self.named)
            found = ~wrong if n % 2 else wrong
        for i in reversed(range(n)):
            found = F.when(self.levels[i].might_hold(key), found).otherwise(F.lit(i % 2 == 1))
        return found


def first_rate(n: int, seen: int) -> float:
    """The false positive rate of level 0."""
    return min(0.5, max(1e-9, n / (math.sqrt(2) * max(1, seen))))


def parts(n: int, seen: int, most: int | None = None) -> int:
    """Into how many parts a list of n keys is dealt, so that each part's cascade stays within the bound: level 0,
    and about twice the list in levels of a half, with a fifth to spare."""
    own = level_bits(max(1, n), first_rate(n, seen))[0] + 4 * n / math.log(2)
    return max(1, math.ceil(1.2 * own / 8 / (most or MAX_FILTER_BYTES)))


def build(listed: DataFrame, universe: DataFrame, scratch: Scratch, seen: int | None = None) -> Cascade:
    """A cascade that is exact for every key of ``listed`` and ``universe`` (column key, about ``seen`` of them)."""
    listed = scratch.cut(listed.where("key is not null").select("key").distinct())
    n = listed.count()
    if not n:
        return Cascade(())
    if seen is None:
        seen = universe.agg(F.approx_count_distinct("key")).first()[0]
    level = encode(listed, n, first_rate(n, seen), 0)
    # The keys that level 0 lets through: about twice the list.  One aggregation tells which are listed.
    flagged = listed.select("key", F.lit(1).alias("listed")).unionByName(universe.select("key", F.lit(0).alias("listed")))
    left = scratch.cut(flagged.where(level.might_hold(F.col("key"))).groupBy("key").agg(F.max("listed").alias("listed")))
    levels, rest = [level], {True: left.where("listed = 1"), False: left.where("listed = 0")}
    while True:
        wrong = rest[len(levels) % 2 == 0]
        n = wrong.count()
        if not n or n <= FEW and len(levels) > 1:
            return Cascade(tuple(levels), tuple(sorted(r["key"] for r in wrong.select("key").collect())))
        levels.append(encode(wrong, n, 0.5, len(levels)))
        other = len(levels) % 2 == 0
        rest[other] = scratch.cut(rest[other].where(levels[-1].might_hold(F.col("key"))))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lowered(host), path


def lowered(host: Column) -> Column:
    """Hosts differ by the case of A-Z in nothing, in rules as in urls."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that could be a url's rule, longest first (of equally long ones the longer host first): for each
    (labels, length) that some rule has the host's last labels and the path's first characters.  The shapes are
    literal arrays, so the expression does not grow with them."""
    labels = sorted({c for c, _ in shapes})
    of, n = F.lit([labels.index(c) for c, _ in shapes]), F.lit([n for _, n in shapes])
    suffixes = _let(F.split(host, "[.]"), lambda x: F.transform(F.lit(labels), lambda c: F.when(F.size(x) >= c, F.array_join(F.slice(x, -c, c), "."))))

    def key(i: Column, x: Column) -> Column:
        suffix, length = F.get(x["s"], F.get(of, i)), F.get(n, i)
        whole = F.concat(suffix, F.substring(x["p"], F.lit(1), length))
        return F.when(suffix.isNotNull() & (F.length(x["p"]) >= length), F.struct(F.length(whole).alias("n"), F.length(suffix).alias("h"), whole.alias("key")))

    keys = _let(F.struct(suffixes.alias("s"), path.alias("p")), lambda x: F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(len(shapes) - 1)), lambda i: key(i, x))))
    return F.transform(F.sort_array(keys, asc=False), lambda x: x["key"])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules``: host, path, action (block or allow).  An url that no listed key fits gets ``default``.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rules = rules.where("host is not null and path is not null and action in ('block', 'allow')")
    rules = rules.select(lowered(F.col("host")).alias("host"), "path", "action").withColumn("key", F.concat("host", "path"))
    # How many labels and characters rules have: small numbers, so few pairs, whatever the list's length.
    shapes = sorted(tuple(r) for r in rules.select(F.size(F.split("host", "[.]")), F.length("path")).distinct().collect())
    host, path = host_and_path(F.col(url))
    parted = pages.withColumns({"host": host, "path": path})
    keys = candidates(F.col("host"), F.col("path"), shapes) if shapes else F.expr("cast(array() as array<string>)")
    universe = parted.select(F.explode(keys).alias("key"))
    listed = rules.select("key", "action").distinct()
    n, seen = listed.count(), universe.agg(F.approx_count_distinct("key")).first()[0] if shapes else 0
    of = parts(n, seen)
    rule, mine = fresh(parted, "_rule", "_mine")
    if of == 1:
        return _finish(parted.withColumn(rule, _best(keys, listed, universe, scratch, seen)), rule, default)
    own = lambda c: F.pmod(F.xxhash64(c, F.lit(99)), F.lit(of))
    judged = parted.withColumn(rule, F.lit(None).cast("struct<key: string, action: string>"))
    part = lambda c, f: F.coalesce(F.length(f(F.col(c)["key"])), F.lit(-1))
    whole, host_of = (lambda k: k), (lambda k: F.substring_index(k, "/", 1))
    for g in range(of):
        best = _best(F.filter(keys, lambda k: own(k) == g), listed.where(own(F.col("key")) == g), universe.where(own(F.col("key")) == g), scratch, seen // of)  # noqa: B023
        longer = part(mine, whole) - part(rule, whole)
        higher = part(mine, host_of) > part(rule, host_of)
        judged = judged.withColumn(mine, best)
        judged = scratch.cut(judged.withColumn(rule, F.when((longer > 0) | ((longer == 0) & higher), F.col(mine)).otherwise(F.col(rule))).drop(mine))
    return _finish(judged, rule, default)


def _best(keys: Column, listed: DataFrame, universe: DataFrame, scratch: Scratch, seen: int) -> Column:
    """The first of ``keys`` that is listed, with its action; null if none is."""
    block, allow = (build(listed.where(F.col("action") == a).select("key"), universe, scratch, seen) for a in ("block", "allow"))
    acted = F.transform(keys, lambda k: F.struct(k.alias("key"), F.when(block.contains(k), "block").when(allow.contains(k), "allow").alias("action")))
    return F.get(F.filter(acted, lambda x: x["action"].isNotNull()), F.lit(0))


def _finish(judged: DataFrame, rule: str, default: str) -> DataFrame:
    best = F.col(rule)
    found = judged.withColumns({"rule": best["key"], "verdict": F.coalesce(best["action"], F.lit(default))})
    return found.drop(rule)
