"""Text helpers as column expressions; white space is Unicode's, as the file formats need."""

from __future__ import annotations

import re
from collections.abc import Generator

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MESSAGES


#: White space as Unicode has it, and the four separators that text files may hold.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends.  Unlike ``trim`` this knows tabs and no-break spaces."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_description(c: Column) -> Column:
    """Control characters become spaces, white space collapses; null if nothing is left."""
    spaced = F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")
    return blank_to_null(strip(F.regexp_replace(spaced, r"(?U)\s+", " ")))


def raw_description(raw: Column, cleaned: Column) -> Column:
    """The raw text where cleaning changed it."""
    return F.when(~raw.eqNullSafe(cleaned), raw)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null if there is no match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def to_json_array(c: Column) -> Column:
    """An array as JSON text, for stores without arrays; null stays null."""
    return F.to_json(c)


def from_json_array(c: Column, kind: str = "array<string>") -> Column:
    """The array of a JSON text; an empty one if the text is no such array, null for null and for JSON's null."""
    return F.when(F.trim(c) != "null", F.coalesce(F.from_json(c, kind), F.expr(f"cast(array() as {kind})")))


def first_token(c: Column) -> Column:
    """Up to two spaces or the end of the line."""
    return strip(F.get(F.split(strip(c), r"(?U)\s{2,}|\n|\r"), F.lit(0)))


def two_decimals(c: Column) -> Column:
    """A decimal as text with two decimals, ties to even."""
    return F.bround(c, 2).cast("decimal(38,2)").cast("string")


def message(name: str, **values: Column) -> Column:
    """One of ``MESSAGES`` with its places filled; null if a value is."""
    text = MESSAGES[name].replace("{{", "\x01").replace("}}", "\x02")
    parts = [values[x] if i % 2 else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for i, x in enumerate(re.split(r"\{(\w+)\}", text)) if x]
    return F.concat(*parts)


def let(value: Column, body) -> Column:
    """Binds a costly expression once for a body that reads it often."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def once(c: Column) -> Column:
    """A costly column that is not written out again in conditions on it, nor in what generates rows from it: these stay
    above what differs between tasks.  Spark compiles a projection with such a column apart from its neighbours and in
    short methods, as the lambda in the condition keeps it out of theirs."""
    return F.when(F.exists(F.array(F.spark_partition_id()), lambda p: p >= 0), c)


#: Steps that are compiled to one method.
TOGETHER = 6
#: Steps of a computation: each yielded expression, or list of them, comes back as columns that may be read often.
Steps = Generator[Column | list[Column], Column | list[Column], Column]


def bound(steps: Steps) -> Column:
    """Steps as one expression, bound by lambdas; these are interpreted, and planned slowly when they are many, so
    ``with_steps`` is faster on a frame."""
    def after(value: Column | list[Column] | None) -> Column:
        try:
            wanted = steps.send(value)
        except StopIteration as end:
            return end.value
        if isinstance(wanted, list):
            return let(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(wanted)]), lambda x: after([x[f"f{i}"] for i in range(len(wanted))]))
        return let(wanted, after)

    return after(None)


def with_steps(df: DataFrame, steps: dict[str, Steps]) -> DataFrame:
    """The frame with a column for each of ``steps``.  Steps go side by side, each round a projection of its own, so
    each is evaluated once.  Spark compiles projections in a row to one method; ``TOGETHER`` steps or a few more, and the
    results, are ``once`` and begin another, as the JVM leaves methods of over 8000 bytes to its interpreter."""
    names, taken, values, n, together = {}, [], dict.fromkeys(steps), 0, 0
    while True:
        wanted, made = {}, {}
        for name in steps:
            if name in names:
                continue
            try:
                wanted[name] = steps[name].send(values[name])
            except StopIteration as end:
                names[name] = end.value
        if not wanted:
            break
        for name, found in wanted.items():
            several = found if isinstance(found, list) else [found]
            own = [f"__{name}_{n}_{i}" for i in range(len(several))]
            made |= dict(zip(own, several, strict=True))
            values[name] = [F.col(c) for c in own] if isinstance(found, list) else F.col(own[0])
        df = df.withColumns(made)
        taken += made
        n += 1
        together += len(made)
        if together >= TOGETHER:  # in every column of the round, as those that nothing reads are left out
            df, together = df.withColumns({c: once(F.col(c)) for c in made}), 0
    # Conditions on the results must not move below the steps, where each would be written out once for every time that
    # it is read.
    return df.withColumns({name: once(c) for name, c in names.items()}).drop(*taken)
