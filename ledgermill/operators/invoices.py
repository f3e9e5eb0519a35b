"""Invoices: fields and line items from text and tables (file_id, text, tables)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions.amounts import amount_steps
from ..functions.dates import date_steps
from ..functions.text import Steps, first_group, first_token, let, message, once, strip, with_steps

TABLES = "array<array<array<string>>>"
_MONEY = "decimal(18,4)"
#: A line's columns that are numbers.
NUMBERS = ("quantity", "unit_price", "line_total", "tax_amount", "tax_rate")


def invoice_number(text: Column) -> Column:
    return strip(F.coalesce(*[first_group(text, p) for p in C.INVOICE_NUMBER]))


def labelled_date(text: Column, pattern: str, rules: C.DateRules = C.DATE_RULES) -> Steps:
    """A struct of ``value`` and ``raw``: the first label's text, if it holds a date."""
    line = yield first_group(text, pattern)
    token = yield first_token(line)
    raw = yield strip(first_group(token, C.DATE_IN_TEXT))
    parsed = yield (yield from date_steps(raw, rules=rules))
    return F.struct(parsed["value"].alias("value"), F.when(parsed["value"].isNotNull(), raw).alias("raw"))


def labelled_amount(text: Column, pattern: str) -> Steps:
    """A struct of ``value`` and ``raw``: the first label's text, if it holds an amount."""
    line = yield first_group(text, pattern)
    token = yield strip(F.regexp_replace(first_token(line), r"(?U)^\([^)]*\)\s*[:\-]?\s*", ""))
    raw = yield strip(first_group(token, C.AMOUNT_IN_TEXT))
    parsed = yield (yield from amount_steps(raw))
    value = yield parsed["value"].try_cast(_MONEY)
    return F.struct(value.alias("value"), F.when(value.isNotNull(), raw).alias("raw"))


def currency_vote(text: Column) -> Column:
    """The currency whose sign and code occur most, USD if none does; earlier ones win ties."""
    low = F.lower(text)
    counts = F.array(*[
        F.struct(sum(((F.length(low) - F.length(F.replace(low, F.lit(m.lower()), F.lit("")))) / len(m)).cast("int") for m in marks).alias("n"), F.lit(-i).alias("i"), F.lit(iso).alias("iso"))
        for i, (iso, marks) in enumerate(C.CURRENCY_MARKS)
    ])
    return let(F.array_max(counts), lambda best: F.when(best["n"] > 0, best["iso"]).otherwise("USD"))


def vendor_name(text: Column) -> Column:
    """A labelled name, else the first line that looks like one."""
    fits = lambda c, least: F.when((F.length(c) > least) & (F.length(c) < 100), c)
    labelled = [fits(first_token(first_group(text, p)), 2) for p in C.VENDOR]
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) > 3) & (F.length(x) < 100) & ~F.regexp_like(x, F.lit(C.NOT_A_VENDOR)))
    return F.coalesce(*labelled, F.get(lines, F.lit(0)))


def confidence(number: Column, date: Column, total: Column, vendor: Column) -> Column:
    """1.00 less 0.15 for each core field that is missing; a total of zero is."""
    missing = sum(F.when(c, 1).otherwise(0) for c in _missing(number, date, total, vendor))
    return F.greatest(F.lit("0.10").cast("decimal(4,3)"), (F.lit(1) - F.lit("0.15").cast("decimal(4,3)") * missing).cast("decimal(4,3)"))


def _missing(number: Column, date: Column, total: Column, vendor: Column) -> list[Column]:
    return [F.coalesce(number, F.lit("")) == "", date.isNull(), F.coalesce(total, F.lit(0)) == 0, F.coalesce(vendor, F.lit("")) == ""]


def fields(docs: DataFrame, rules: C.DateRules = C.DATE_RULES) -> DataFrame:
    """Header fields of each text, ``confidence`` and ``missing`` (names of missing core fields)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({"invoice_number": invoice_number(text), "currency": currency_vote(text), "raw_vendor_name": vendor_name(text)})
    found = with_steps(found, {
        "_date": labelled_date(text, C.INVOICE_DATE, rules), "_due": labelled_date(text, C.DUE_DATE, rules), "_subtotal": labelled_amount(text, C.SUBTOTAL),
        "_tax": labelled_amount(text, C.TAX), "_discount": labelled_amount(text, C.DISCOUNT), "_total": labelled_amount(text, C.TOTAL),
    })
    found = found.withColumns({
        "invoice_date": F.col("_date.value"), "raw_date_text": F.col("_date.raw"), "due_date": F.col("_due.value"), "subtotal": F.col("_subtotal.value"),
        "tax_amount": F.col("_tax.value"), "discount_amount": F.col("_discount.value"), "total_amount": F.col("_total.value"), "raw_total_text": F.col("_total.raw"),
    }).drop("_date", "_due", "_subtotal", "_tax", "_discount", "_total")
    core = [F.col(c) for c in ("invoice_number", "invoice_date", "total_amount", "raw_vendor_name")]
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for m, n in zip(_missing(*core), ("invoice_number", "invoice_date", "total_amount", "vendor_name"), strict=True)]))
    return found.withColumns({"confidence": confidence(*core), "missing": names})


def _holds_one(low: Column, keys: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds a keyword; those that hold another one say nothing more."""
    return reduce(or_, [F.contains(low, F.lit(k)) for k in keys if not any(o != k and o in k for o in keys)])


def line_field(cell: Column) -> Column:
    """The logical column of a header cell: the first field of which it holds a keyword."""
    return let(F.lower(F.coalesce(cell, F.lit(""))), lambda low: F.coalesce(*[F.when(_holds_one(low, keys), F.lit(f)) for f, keys in C.LINE_COLUMNS.items()]))


def best_table(tables: Column) -> Column:
    """A struct of ``rows`` and ``columns`` (each cell's field): the first table and row among its first five
    that names the most columns, two at least, the description among them.  Null if there is none."""
    def fields_of(row: Column) -> Column:
        # Cells are looked at one by one only in rows that may name the description.
        named = let(F.lower(F.array_join(row, "\n")), lambda low: _holds_one(low, C.LINE_COLUMNS["description"]))
        return F.when(named, F.transform(row, line_field))

    def of_table(t: Column, at: Column) -> Column:
        rows = F.transform(F.slice(t, 1, 5), lambda r, i: F.struct(fields_of(r).alias("c"), i.alias("i")))
        usable = F.filter(rows, lambda x: x["c"].isNotNull() & F.array_contains(x["c"], "description") & (F.size(F.array_compact(x["c"])) >= 2))
        return F.transform(usable, lambda x: F.struct(F.size(F.array_compact(x["c"])).alias("n"), (-at).alias("t"), (-x["i"]).alias("i"), x["c"].alias("c")))

    every = F.flatten(F.transform(tables, lambda t, at: F.when(F.size(t) >= 2, of_table(t, at)).otherwise(F.expr("cast(array() as array<struct<n:int,t:int,i:int,c:array<string>>>)"))))
    return let(F.array_max(every), lambda b: F.when(b.isNotNull(), F.struct(
        F.slice(F.get(tables, -b["t"]), -b["i"] + 2, F.size(F.get(tables, -b["t"]))).alias("rows"), b["c"].alias("columns"))))


def _lines(rows: DataFrame) -> DataFrame:
    """Typed lines from text columns and each line's place (from 0); a missing total or price follows from the others."""
    typed = with_steps(rows, {f"p_{k}": amount_steps(F.col(f"r_{k}")) for k in NUMBERS})
    bad = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"p_{k}.error"), F.lit(False)), F.lit(k)) for k in NUMBERS]))
    quantity, price, total = F.col("p_quantity.value"), F.col("p_unit_price.value"), F.col("p_line_total.value")
    return typed.select(
        "file_id", (F.col("at") + 1).cast("smallint").alias("line_number"), F.col("r_description").alias("description"),
        quantity.try_cast("decimal(12,4)").alias("quantity"),
        F.coalesce(price.try_cast(_MONEY), F.when(total.isNotNull() & (quantity > 0), F.try_divide(total, quantity)).try_cast(_MONEY)).alias("unit_price"),
        F.coalesce(total.try_cast(_MONEY), (quantity.try_cast("decimal(12,4)") * price.try_cast(_MONEY)).try_cast(_MONEY)).alias("line_total"),
        F.col("p_tax_rate.value").try_cast("decimal(6,4)").alias("tax_rate"), F.col("p_tax_amount.value").try_cast(_MONEY).alias("tax_amount"),
        F.col("r_sku").alias("sku"), F.col("r_unit_of_measure").alias("unit_of_measure"), bad.alias("bad_fields"),
    )


def _place(columns: Column, field: str) -> Column:
    """Where rows have a logical column (from 0), null if nowhere; of several columns of one name the last counts."""
    return F.when(F.array_contains(columns, field), F.size(columns) - F.array_position(F.reverse(columns), field).cast("int"))


def _cell(row: Column, place: Column) -> Column:
    """A row's cell, null if blank or if there is no place."""
    return F.nullif(strip(F.get(row, place)), F.lit(""))


def _is_line(description: Column) -> Column:
    return F.coalesce(~F.regexp_like(description, F.lit(C.SUMMARY_LINE)), F.lit(False))


def has_table_lines(best: Column) -> Column:
    """Whether a best table has a row that is a line item."""
    return F.coalesce(let(_place(best["columns"], "description"), lambda at: F.exists(best["rows"], lambda r: _is_line(_cell(r, at)))), F.lit(False))


def table_lines(docs: DataFrame, best: Column | None = None) -> DataFrame:
    """Line items of each document's best table.  A cell that is no number is null and named in bad_fields.  Lines are
    told and counted within their document, so no rows change places."""
    found = docs.select("file_id", once(best_table(F.col("tables")) if best is None else best).alias("b")).where("b is not null")
    placed = found.select("file_id", F.col("b.rows").alias("rows"), *[_place(F.col("b.columns"), f).alias(f"at_{f}") for f in C.LINE_COLUMNS])
    held = placed.withColumn("rows", once(F.filter("rows", lambda r: _is_line(_cell(r, F.col("at_description"))))))
    rows = held.select("file_id", *[f"at_{f}" for f in C.LINE_COLUMNS], F.posexplode("rows").alias("at", "row"))
    return _lines(rows.withColumns({f"r_{f}": _cell(F.col("row"), F.col(f"at_{f}")) for f in C.LINE_COLUMNS}))


def text_lines(docs: DataFrame) -> DataFrame:
    """Line items from lines of text between a header line and a summary line."""
    is_header, is_end = (lambda x: F.regexp_like(x, F.lit(C.TEXT_TABLE_HEADER))), (lambda x: F.regexp_like(x, F.lit(C.SUMMARY_LINE)))
    first = lambda lines, fits: F.array_position(F.transform(lines, fits), True).cast("int")
    lines = docs.select("file_id", once(F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")).alias("lines"))
    begun = lines.withColumn("head", once(first(F.col("lines"), is_header))).where("head > 0")
    inside = begun.select("file_id", once(F.filter(F.slice("lines", F.col("head") + 1, F.size("lines")), lambda x: ~is_header(x))).alias("lines"))
    ended = inside.withColumn("end", once(first(F.col("lines"), is_end)))
    kept = F.when(F.col("end") > 0, F.slice("lines", F.lit(1), F.col("end") - 1)).otherwise(F.col("lines"))
    rows = ended.select("file_id", once(F.filter(kept, lambda x: F.regexp_like(x, F.lit(C.TEXT_TABLE_ROW)))).alias("lines")).select("file_id", F.posexplode("lines").alias("at", "line"))
    group = lambda i: strip(F.regexp_extract("line", C.TEXT_TABLE_ROW, i))
    none = F.lit(None).cast("string")
    return _lines(rows.withColumns({
        "r_description": group(1), "r_quantity": group(2), "r_unit_price": group(3), "r_line_total": group(4),
        "r_sku": none, "r_unit_of_measure": none, "r_tax_amount": none, "r_tax_rate": none,
    }))


def line_totals(lines: DataFrame) -> DataFrame:
    """Per document n_lines, lines_sum and bad (the first line with a cell that is no number)."""
    # The first bad line as one number, its place above the marks of its fields: sums of numbers need no sorting.
    marks, many = sum(F.when(F.array_contains("bad_fields", k), 1 << i).otherwise(0) for i, k in enumerate(NUMBERS)), 1 << len(NUMBERS)
    first = F.min(F.when(F.size("bad_fields") > 0, F.col("line_number").cast("long") * many + marks)).alias("_first")
    totals = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("line_total"), F.lit(0)).cast(_MONEY).alias("lines_sum"), first)
    names = F.array_compact(F.array(*[F.when(F.col("_first").bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(NUMBERS)]))
    bad = F.struct(F.shiftright("_first", len(NUMBERS)).cast("smallint").alias("line_number"), F.array_join(names, ", ").alias("f"))
    return totals.withColumn("bad", F.when(F.col("_first").isNotNull(), bad)).drop("_first")


def reconcile(invoices: DataFrame, totals: DataFrame, limits: C.Limits = C.LIMITS) -> DataFrame:
    """Adds the totals of the lines (``line_totals``) and ``reconciliation`` (an array of notes): the lines
    against the subtotal, and subtotal (else lines) + tax - discount against the total; nothing without lines."""
    joined = invoices.join(totals, "file_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(_MONEY))
    calc = (F.coalesce("subtotal", "lines_sum") + zero("tax_amount") - zero("discount_amount")).cast(_MONEY)
    tolerance = F.lit(limits.total_tolerance).cast(_MONEY)
    number = lambda c: c.cast(_MONEY).cast("string")
    first, second = F.abs(F.col("lines_sum") - F.col("subtotal")), F.abs(calc - F.col("total_amount"))
    notes = F.array_compact(F.array(
        F.when(first > tolerance, message("lines_and_subtotal", lines=number(F.col("lines_sum")), stated=number(F.col("subtotal")), gap=number(first))),
        F.when(second > tolerance, message("total", calculated=number(calc), stated=number(F.col("total_amount")), gap=number(second))),
    ))
    return joined.withColumn("reconciliation", F.when(F.col("n_lines").isNotNull(), notes).otherwise(F.expr("cast(array() as array<string>)")))


def parse(docs: DataFrame, rules: C.DateRules = C.DATE_RULES, limits: C.Limits = C.LIMITS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(invoices, lines).  Tables give the lines; texts do where no table has any.  ``strict`` fails an
    invoice of which a line has a cell that is no number, instead of leaving that cell null."""
    viewed = docs.withColumn("_best", once(best_table(F.col("tables"))))
    lines = table_lines(viewed, F.col("_best")).unionByName(text_lines(viewed.where(~has_table_lines(F.col("_best")))))
    found = reconcile(fields(docs.drop("tables"), rules), line_totals(lines), limits)
    none = F.expr("cast(array() as array<string>)")
    missing = F.when(F.size("missing") > 0, F.array(message("missing_fields", fields=F.array_join("missing", ", ")))).otherwise(none)
    bad = F.when(F.col("bad").isNotNull(), F.array(F.concat(F.lit("Line "), F.col("bad.line_number").cast("string"), F.lit(": no number in "), F.col("bad.f")))).otherwise(none)
    found = found.withColumn("warnings", F.concat(missing, "reconciliation", bad))
    notes = F.when(F.size("warnings") > 0, message("warnings", all=F.array_join("warnings", "; "))).otherwise(message("no_warnings"))
    error = F.when(F.col("bad").isNotNull(), "PARTIAL_PARSE") if strict else F.lit(None).cast("string")
    found = found.withColumns({"notes": notes, "error_code": error}).drop("reconciliation", "bad", "missing", "text")
    return found, lines
