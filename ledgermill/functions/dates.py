"""Dates: messy text to dates, with a mark on those whose day and month could be swapped."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DATE_RULES, DateRules
from .text import Steps, bound, message, strip

#: Tokens for a missing date.
NULL_TOKENS = ("", "-", "--", "n/a", "na", "nil", "none", "null", "pending", "tbd")
TYPE = "struct<value:date,is_ambiguous:boolean,is_excel_serial:boolean,error:boolean,warning:string>"

#: A time after a date, with a zone, or of twelve hours.
_TIME = r"[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
_CLOCK = r"(?i)[T ]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?( ?[ap]m)?( ?(utc|gmt|z))?$"
_WEEKDAY = r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[/ ,]+"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
#: A month's name with what stands before and after it: number, its ending, separators, number, ending, separators, number.
_NAMED = rf"^(?:([0-9]{{4}}|[0-9]{{1,2}})(st|nd|rd|th)?[/ ,]*)?({_MONTHS.replace(' ', '|')})[a-z]*(?:([/ ,]*)([0-9]{{4}}|[0-9]{{1,2}})(st|nd|rd|th)?(?:[/ ,]+([0-9]{{4}}|[0-9]{{2}}))?)?$"


def _day(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is none such."""
    return F.to_date(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)))


def _whole(c: Column) -> Column:
    return c.try_cast("int")


def date_steps(raw: Column, dayfirst: bool = True, rules: DateRules = DATE_RULES) -> Steps:
    """``parse_date`` in steps.  What a text is shows in its shape, digits written as 9: each shape has one reader, and a
    month's name is looked for only where there is a letter."""
    s = yield strip(raw)
    clocked = F.contains(s, F.lit(":"))
    t = yield F.when(clocked, strip(F.regexp_replace(F.regexp_replace(s, _TIME, ""), _CLOCK, ""))).otherwise(s)
    n = yield F.lower(F.translate(t, "-.", "//"))
    lettered = F.regexp_like(n, F.lit("[a-z]"))
    low = yield F.when(lettered, F.regexp_replace(n, _WEEKDAY, "")).otherwise(n)
    shape = F.translate(F.translate(low, "012345678", "999999999"), " ", "/")
    numbers, named, compact, iso = yield [
        F.when(shape.rlike("^(9{1,2}/9{1,2}/(99|9999)|9999/9{1,2}/9{1,2})$"), F.split(F.translate(low, " ", "/"), "/")),
        F.when(lettered & F.regexp_like(low, F.lit(_NAMED)), F.split(F.regexp_replace(low, _NAMED, "$1#$2#$3#$4#$5#$6#$7"), "#", -1)),
        shape == "99999999",
        F.when(F.regexp_like(t, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(t, "yyyy-MM-dd")),
    ]
    year = lambda text: F.when(F.length(text) > 2, _whole(text)).when(_whole(text) > rules.pivot, _whole(text) + 1900).otherwise(_whole(text) + 2000)
    x = [F.get(numbers, F.lit(i)) for i in range(3)]
    b, b_end, month_name, sep, a, a_end, last = (F.get(named, F.lit(i)) for i in range(7))
    short, no = lambda c: F.length(c).between(1, 2), lambda c: c == ""
    three, y_first = numbers.isNotNull(), F.length(x[0]) == 4
    # What the parts around a month's name are: its day, its year or both; 0 where they make no date.
    month, kind = yield [
        _whole((F.instr(F.lit(_MONTHS), month_name) + 3) / 4),
        F.when(short(b) & no(last) & no(a_end) & (F.length(a) >= 2), 1)
        .when(no(b) & short(a) & ~no(last) & ~F.contains(sep, F.lit(",")), 2)
        .when((F.length(b) == 4) & no(b_end) & short(a) & no(a_end) & no(last), 3)
        .when(no(b) & (F.length(a) == 4) & no(a_end) & no(last), 4)
        .when(no(b) & short(a) & no(a_end) & no(last), 5)
        .when(short(b) & no(b_end) & no(a), 6).otherwise(0),
    ]
    p, q = (F.when(y_first, x[i + 1]).otherwise(x[i]) for i in (0, 1))
    day, other_part = (p, q) if dayfirst else (q, p)
    y_text, m_text, d_text = yield [
        F.when(three, F.when(y_first, x[0]).otherwise(x[2])).when(compact, F.substring(low, 1, 4)).when(kind == 1, a).when(kind == 2, last).when(kind == 3, b).when(kind == 4, a),
        F.when(three, other_part).when(compact, F.substring(low, 5, 2)),
        F.when(three, day).when(compact, F.substring(low, 7, 2)).when(kind.isin(1, 6), b).when(kind.isin(2, 3, 5), a),
    ]
    y, m = yield [F.when((kind >= 5) & ~three & ~compact, F.lit(rules.default.year)).otherwise(year(y_text)), F.coalesce(_whole(m_text), month)]
    d = yield F.coalesce(_whole(d_text), F.when(kind == 4, F.least(F.lit(rules.default.day), F.day(F.last_day(_day(y, m, F.lit(1)))))))
    v = yield F.coalesce(iso, _day(y, m, d), F.when(three, _day(y, d, m)))
    both, serial = yield [
        F.when(three, F.slice(numbers, 1, 2)).when(named.isNotNull(), F.slice(F.regexp_extract_all(low, F.lit("([0-9]+)"), F.lit(1)), 1, 2)),
        F.when(F.regexp_like(s, F.lit("^[0-9]{4,6}$")), F.date_add(F.to_date(F.lit("1899-12-30")), _whole(s))),
    ]
    first, second = (_whole(F.get(both, F.lit(i))) for i in (0, 1))
    unsure = yield F.coalesce(iso.isNull() & v.isNotNull() & (first <= 12) & (second <= 12) & (first != second), F.lit(False))
    other = F.coalesce(_day(F.year(v), F.day(v), F.month(v)).cast("string"), F.lit("another date"))
    is_serial = serial.isNotNull()
    warning = (
        F.when(is_serial, message("serial_date", serial=_whole(s).cast("string"), date=serial.cast("string")))
        .when(unsure, message("day_first" if dayfirst else "month_first", date=v.cast("string"), other=other))
    )
    found = F.struct(
        F.coalesce(serial, v).alias("value"), (unsure & ~is_serial).alias("is_ambiguous"), is_serial.alias("is_excel_serial"),
        (v.isNull() & ~is_serial).alias("error"), warning.alias("warning"),
    )
    return F.when(~F.lower(s).isin(*NULL_TOKENS), found).cast(TYPE)


def parse_date(raw: Column, dayfirst: bool = True, rules: DateRules = DATE_RULES) -> Column:
    """A struct ``TYPE``, null for a missing date.  Four to six digits are a spreadsheet's serial number; an
    ISO date is itself; of anything else the separators do not matter, and day and month are swapped where
    only that gives a date.  A weekday before and a time after the date are no part of it."""
    return bound(date_steps(raw, dayfirst, rules))
