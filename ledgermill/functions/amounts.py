"""Amounts: messy text to exact decimals with a direction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import Steps, bound, message, strip

#: Tokens for a missing amount, currency signs, and suffixes that name the direction.
NULL_TOKENS = ("", "-", "--", "n/a", "na", "nil", "none", "null", "0.00")
SIGNS = "£$€₹¥₩₺฿₪₨"
DEBIT_SUFFIXES = ("dr", "debit", "d", "withdrawal", "withdraw")
CREDIT_SUFFIXES = ("cr", "credit", "c", "deposit", "dep")

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TYPE = "struct<value:decimal(38,10),direction:string,is_inferred:boolean,error:boolean>"
SPLIT_TYPE = "struct<value:decimal(38,10),direction:string,is_inferred:boolean,error:boolean,warning:string>"


def _normalised(s: Column) -> Column:
    """Locale marks out of a number: European when commas end it before one or two digits and it has dots;
    a lone comma before at most two digits is a decimal comma; any other comma separates thousands."""
    comma, dot = F.lit(","), F.lit(".")
    commas = F.length(s) - F.length(F.replace(s, comma, F.lit("")))
    tail = F.length(F.substring_index(s, ",", -1))
    dotted = F.contains(s, dot)
    european = dotted & tail.between(1, 2) & F.regexp_like(s, F.lit(r",[0-9]{1,2}$"))
    return (
        F.when(~F.contains(s, comma), s)
        .when(european, F.translate(s, ",.", "."))
        .when(~dotted & (commas == 1) & (tail <= 2), F.replace(s, comma, dot))
        .otherwise(F.replace(s, comma, F.lit("")))
    )


def amount_steps(raw: Column, default_direction: str = "D") -> Steps:
    """``parse_amount`` in steps."""
    s = yield strip(raw)
    wrapped = s.startswith("(") & s.endswith(")")
    inner = F.when(wrapped, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    u = yield strip(F.translate(inner, SIGNS, ""))
    # Only text that ends in a letter can end in a word.
    word = yield F.when(F.right(u, F.lit(1)).between("A", "z"), F.lower(F.regexp_extract(u, r"(?U)\s([a-zA-Z]+)$", 1))).otherwise("")
    debit, credit = word.isin(*DEBIT_SUFFIXES), word.isin(*CREDIT_SUFFIXES)
    body = yield F.replace(F.when(debit | credit, strip(F.substring(u, F.lit(1), F.length(u) - F.length(word)))).otherwise(u), F.lit(" "), F.lit(""))
    n = yield _normalised(body)
    value = yield F.when(F.regexp_like(n, F.lit(_NUMBER)), n.try_cast("decimal(38,10)"))
    explicit = F.when(debit, "D").when(credit, "C").when(wrapped, "D")
    given, negative = value.isNotNull(), F.coalesce(value < 0, F.lit(False))
    found = F.struct(
        F.abs(value).alias("value"),
        F.when(given, F.when(negative, "D").otherwise(F.coalesce(explicit, F.lit(default_direction)))).alias("direction"),
        (given & explicit.isNull() & ~negative).alias("is_inferred"),
        (~given).alias("error"),
    )
    return F.when(~F.lower(s).isin(*NULL_TOKENS), found).cast(TYPE)


def parse_amount(raw: Column, default_direction: str = "D") -> Column:
    """A struct ``TYPE``, null for a missing amount.  ``error`` marks what is no amount.  The direction is a
    suffix's, else D in parentheses, else the default (inferred); a minus makes it D whatever else."""
    return bound(amount_steps(raw, default_direction))


def split_steps(debit: Column, credit: Column) -> Steps:
    """``parse_split`` in steps."""
    d = yield (yield from amount_steps(debit, "D"))
    c = yield (yield from amount_steps(credit, "C"))
    two = d.isNotNull() & c.isNotNull()
    first = d.isNotNull() & (c.isNull() | (d["value"] >= c["value"]))
    failed = F.coalesce(d["error"], F.lit(False)) | F.coalesce(c["error"], F.lit(False))
    pick = lambda f: F.when(first, d[f]).otherwise(c[f])
    found = F.struct(
        F.when(~failed, pick("value")).alias("value"),
        F.when(~failed, F.when(two, pick("direction")).when(first, "D").otherwise("C")).alias("direction"),
        (~failed & two & pick("is_inferred")).alias("is_inferred"),
        failed.alias("error"),
        F.when(~failed & two, message("both_sides")).alias("warning"),
    )
    return F.when(d.isNotNull() | c.isNotNull(), found).cast(SPLIT_TYPE)


def parse_split(debit: Column, credit: Column) -> Column:
    """One amount of a debit and a credit cell, a struct ``SPLIT_TYPE``: the larger of two (the debit on a
    tie) with a warning; the column of a lone one is its direction; an error on either side is an error."""
    return bound(split_steps(debit, credit))


def parse_balance(raw: Column) -> Column:
    """A running balance; its sign is not kept, and text that is no amount is null."""
    return parse_amount(raw, "C")["value"]
