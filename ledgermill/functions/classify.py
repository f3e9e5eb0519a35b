"""Transaction types and bank formats."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from ..config import BANK_FORMATS, EXPLICIT_TYPES, TYPE_KEYWORDS
from .text import let, strip


def transaction_type(explicit: Column, description: Column, direction: Column) -> Column:
    """The explicit type if it is known, else the first keyword's in the description, else by direction."""
    word = F.lower(strip(F.coalesce(explicit, F.lit(""))))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in EXPLICIT_TYPES.items() for x in kv]), F.when(word.isin(*EXPLICIT_TYPES), word))
    by_word = F.coalesce(*[F.when(F.regexp_like(description, F.lit("(?iU)" + pattern)), F.lit(kind)) for pattern, kind in TYPE_KEYWORDS])
    return F.coalesce(known, by_word, F.when(direction == "C", "credit").otherwise("debit"))


def format_of(low: Column) -> Column:
    """The first format whose headers are all in ``low``, lower-cased cells without white space at their ends."""
    found = [F.when(reduce(and_, [F.array_contains(low, h) for h in need]), F.lit(name)) for name, need in BANK_FORMATS]
    return F.coalesce(*found, F.lit("UNKNOWN"))


def bank_format(headers: Column) -> Column:
    """The first format whose headers are all there; ``headers`` is an array of cells."""
    return let(F.transform(headers, lambda h: F.lower(strip(h))), format_of)
