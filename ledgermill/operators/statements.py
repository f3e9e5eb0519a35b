"""Bank statements: from grids of cells to typed transactions and one summary per file."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DATE_RULES, LIMITS, REPEATED_HEADERS, SUMMARY_ROW, SYNONYMS, DateRules, Limits
from ..functions.amounts import amount_steps, split_steps
from ..functions.classify import bank_format, transaction_type
from ..functions.dates import date_steps
from ..functions.text import Steps, blank_to_null, clean_description, let, message, raw_description, strip, two_decimals, with_steps

#: What counts towards a header row: every synonym but those of the type column.
_SIGNALS = sorted({s for field, names in SYNONYMS.items() if field != "transaction_type" for s in names})
WARNING = "array<struct<field:string,message:string>>"


@dataclass(frozen=True)
class Statements:
    transactions: DataFrame  # file_id, row_index and the transaction's columns
    statements: DataFrame  # one row per file, error_code set where it failed
    rows: DataFrame  # every data row with its fate: parsed, skipped or dropped


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def header_matches(cells: Column) -> Column:
    """Number of cells that are a known header, or hold one of more than four characters."""
    low = F.transform(cells, lambda c: F.lower(strip(c)))
    long = "|".join(re.escape(s) for s in _SIGNALS if len(s) > 4)
    return F.size(F.filter(low, lambda c: c.isin(_SIGNALS) | F.regexp_like(c, F.lit(long))))


def find_column(headers: Column, names: tuple[str, ...]) -> Column:
    """0-based position of a logical column: names in order, first exact, then as a beginning (over three
    characters), then anywhere (over four).  Null if absent.  ``headers`` are lower-cased."""
    def one(usable: list[str], position) -> Column:
        if not usable:
            return F.lit(None).cast("int")
        at = F.transform(_strings(usable), position)
        return F.get(F.filter(at, lambda x: x > 0), F.lit(0)).cast("int") - 1

    fitting = lambda fits: lambda n: F.array_position(F.transform(headers, lambda h: fits(h, n)), True)
    return F.coalesce(
        one(list(names), lambda n: F.array_position(headers, n)),
        one([n for n in names if len(n) > 3], fitting(F.startswith)),
        one([n for n in names if len(n) > 4], fitting(F.contains)),
    )


def map_columns(header: Column) -> Column:
    """A struct of positions, one per logical column."""
    def fields(low: Column) -> Column:
        at = {f: find_column(low, names) for f, names in SYNONYMS.items()}
        at["value_date"] = F.nullif(at["value_date"], at["date"])
        return F.struct(*[at[f].alias(f) for f in SYNONYMS])

    return let(F.transform(header, lambda c: F.lower(strip(c))), fields)


def layouts(grid: DataFrame) -> DataFrame:
    """One row per file: header_line, header, columns (positions), delimiter, missing (required columns).

    Looks at the first 15 records only, so it shuffles little; evaluated once per file.
    """
    top = grid.where("line_no <= 15").withColumn("m", header_matches(F.col("cells")))
    heads = top.groupBy("file_id").agg(
        F.first("delimiter").alias("delimiter"),
        F.min_by("cells", F.when(F.col("m") >= 2, F.col("line_no"))).alias("found"), F.min(F.when(F.col("m") >= 2, F.col("line_no"))).alias("at"),
        F.min_by("cells", "line_no").alias("first"),
    )
    heads = heads.select("file_id", "delimiter", F.coalesce("at", F.lit(1)).alias("header_line"), F.when(F.col("at").isNotNull(), F.col("found")).otherwise(F.col("first")).alias("header"))
    mapped = heads.withColumn("columns", map_columns(F.col("header")))
    c = F.col("columns")
    missing = F.array_compact(F.array(F.when(c["date"].isNull(), "date"), F.when(c["amount"].isNull() & c["debit"].isNull() & c["credit"].isNull(), "amount (or debit/credit)")))
    return mapped.withColumn("missing", missing)


def skip_reason(cells: Column, n_columns: Column) -> Column:
    """Why a data row is no transaction; null if it may be one."""
    first = strip(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    return F.coalesce(
        F.when(F.forall(cells, lambda c: strip(c) == ""), "blank_row"),
        F.when(F.size(cells) < F.greatest(F.lit(2), n_columns - 2), "too_few_columns"),
        F.when(F.regexp_like(first, F.lit(SUMMARY_ROW)), "summary_row"),
        F.when(F.lower(first).isin(*REPEATED_HEADERS), "repeated_header_row"),
    )


def data_rows(grid: DataFrame, layout: DataFrame, max_rows: int = LIMITS.max_csv_rows) -> DataFrame:
    """Rows below the header, at most ``max_rows`` records of each file, with their skip_reason."""
    rows = grid.drop("delimiter").join(layout.where(F.size("missing") == 0).select("file_id", "header_line", "header", "columns"), "file_id")
    rows = rows.where((F.col("line_no") > F.col("header_line")) & (F.col("line_no") <= F.col("header_line") + max_rows))
    return rows.withColumn("skip_reason", skip_reason(F.col("cells"), F.size("header")))


def parse_rows(rows: DataFrame, rules: DateRules = DATE_RULES, default_direction: str = "D") -> DataFrame:
    """Typed columns of data rows that are not skipped; transaction_date is null where the row is dropped."""
    at = F.col("columns")
    cell = lambda f: strip(F.coalesce(F.get("cells", at[f]), F.lit("")))
    raw = rows.select(
        "file_id", F.col("line_no").alias("row_index"), "skip_reason", *[cell(f).alias(f"r_{f}") for f in SYNONYMS],
        (at["debit"].isNotNull() | at["credit"].isNotNull()).alias("split"), at["value_date"].isNotNull().alias("has_value_date"), at["balance"].isNotNull().alias("has_balance"),
    )
    def amount(debit: Column, credit: Column, single: Column, split: Column) -> Steps:
        """One amount of two cells, or of one."""
        two = yield (yield from split_steps(F.when(split, debit), F.when(split, credit)))
        one = yield (yield from amount_steps(F.when(~split, single), default_direction))
        alone = F.struct(*[one[f].alias(f) for f in ("value", "direction", "is_inferred", "error")], F.lit(None).cast("string").alias("warning"))
        return F.when(split, two).when(one.isNotNull(), alone)

    def failed_side(split: Column) -> Steps:
        debit = yield (yield from amount_steps(F.when(split, F.col("r_debit"))))
        return F.when(F.coalesce(debit["error"], F.lit(False)), F.col("r_debit")).otherwise(F.col("r_credit"))

    failed, missing = F.coalesce(F.col("a.error"), F.lit(False)), F.col("a").isNull() | F.col("a.error")
    parsed = with_steps(raw, {
        "d": date_steps(F.col("r_date"), rules=rules),
        "v": date_steps(F.col("r_value_date"), rules=rules),
        "a": amount(F.col("r_debit"), F.col("r_credit"), F.col("r_amount"), F.col("split")),
        "b": amount_steps(F.col("r_balance"), "C"),
    }).withColumn("description", clean_description(F.col("r_description")))
    # Which of two cells is at fault is asked of those rows alone that have one.
    parsed = with_steps(parsed, {"bad_side": failed_side(F.col("split") & failed)})
    bad_side = F.col("bad_side")
    value = F.col("a.value").try_cast("decimal(18,4)")
    warnings = F.array_compact(F.array(
        F.when(F.col("d.warning").isNotNull(), message("date", text=F.col("d.warning"))),
        F.when(F.coalesce(F.col("v.error"), F.lit(False)), message("bad_value_date")),
        F.when(failed & F.col("split"), message("bad_split", text=bad_side)),
        F.when(failed & ~F.col("split"), message("bad_amount", text=F.col("r_amount"))),
        F.when(missing, message("no_amount")),
        F.when(~missing & value.isNull(), "amount: Outside the range of stored amounts"),
        F.when(F.col("a.warning").isNotNull(), message("amount", text=F.col("a.warning"))),
        F.when(F.coalesce(F.col("a.is_inferred"), F.lit(False)), message("inferred")),
        F.when(F.coalesce(F.col("b.error"), F.lit(False)), message("bad_balance")),
    ))
    direction = F.when(missing, "D").otherwise(F.col("a.direction"))
    return parsed.select(
        "file_id", "row_index", "skip_reason", F.col("d.value").alias("transaction_date"), F.col("v.value").alias("value_date"), "description",
        raw_description(F.col("r_description"), F.col("description")).alias("raw_description"), blank_to_null(F.col("r_reference")).alias("reference_number"),
        transaction_type(F.col("r_transaction_type"), F.col("description"), direction).alias("transaction_type"),
        F.coalesce(value, F.lit(0).cast("decimal(18,4)")).alias("amount"), direction.alias("direction"),
        F.col("b.value").try_cast("decimal(18,4)").alias("balance_after"), blank_to_null(F.upper("r_currency")).alias("currency"), warnings.alias("parse_warnings"),
    )


def with_continuity(transactions: DataFrame, key: str = "file_id", limits: Limits = LIMITS) -> DataFrame:
    """Adds expected_balance and balance_gap (null unless it is over the tolerance and every balance of the
    statement is known)."""
    order, whole = W.partitionBy(key).orderBy("row_index"), W.partitionBy(key)
    before = F.lag("balance_after").over(order)
    expected = F.when(F.col("direction") == "C", before + F.col("amount")).otherwise(before - F.col("amount")).cast("decimal(18,4)")
    complete = F.count("balance_after").over(whole) == F.count(F.lit(1)).over(whole)
    checked = transactions.withColumns({"expected_balance": expected, "_complete": complete})
    gap = F.abs(F.col("expected_balance") - F.col("balance_after")).cast("decimal(18,4)")
    return checked.withColumn("balance_gap", F.when(F.col("_complete") & (gap > F.lit(limits.balance_tolerance).cast("decimal(18,4)")), gap)).drop("_complete")


def summarise(transactions: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per statement from its transactions (with ``with_continuity``'s columns); shares its exchange."""
    row = lambda field, message: F.struct(field.alias("field"), message.alias("message"))
    number = F.col("row_index").cast("string")
    gap = F.when(F.col("balance_gap").isNotNull(), F.struct(F.col("row_index"), row(
        F.concat(F.lit("balance_row_"), number),
        message("gap", row=number, expected=two_decimals(F.col("expected_balance")), found=two_decimals(F.col("balance_after")), gap=two_decimals(F.col("balance_gap"))),
    ).alias("w")))
    per_row = F.when(F.size("parse_warnings") > 0, F.struct(F.col("row_index"), row(F.concat(F.lit("row_"), number), F.array_join("parse_warnings", "; ")).alias("w")))
    summed = transactions.groupBy(key).agg(
        F.min("transaction_date").alias("statement_from"), F.max("transaction_date").alias("statement_to"),
        F.mode("currency", True).alias("currency"), F.array_sort(F.collect_set("currency")).alias("currencies"),
        F.min_by("balance_after", "row_index").alias("opening_balance"), F.max_by("balance_after", "row_index").alias("closing_balance"),
        F.count(F.lit(1)).cast("int").alias("total_rows_parsed"),
        F.sort_array(F.collect_list(gap)).alias("_gaps"), F.sort_array(F.collect_list(per_row)).alias("_rows"),
    )
    several = F.when(F.size("currencies") > 1, F.array(row(F.lit("currency"), message("currencies", all=F.array_join("currencies", "', '"), dominant=F.col("currency"))))
    ).otherwise(F.expr(f"cast(array() as {WARNING})"))
    return summed.withColumn("warnings", F.concat(several, F.transform("_gaps", lambda x: x["w"]), F.transform("_rows", lambda x: x["w"]))).drop("_gaps", "_rows")


def parse(grid: DataFrame, files: DataFrame, limits: Limits = LIMITS, rules: DateRules = DATE_RULES, default_direction: str = "D", stage: Callable[[DataFrame], DataFrame] | None = None) -> Statements:
    """All of it.  ``grid`` as the tokeniser makes it, ``files`` with at least file_id and encoding: files
    without records or with missing columns get an error_code and no transactions, and records of other files are
    left out.  ``stage`` writes the parsed
    rows and reads them again, so that each is parsed once though transactions and summaries both need it."""
    layout = files.select("file_id", "encoding").join(layouts(grid), "file_id", "left")
    rows = parse_rows(data_rows(grid, layout.where("header is not null"), limits.max_csv_rows), rules, default_direction)
    fate = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("transaction_date").isNull(), "dropped").otherwise("parsed")
    rows = rows.withColumn("fate", fate)
    rows = rows if stage is None else stage(rows)
    transactions = with_continuity(rows.where("fate = 'parsed'").drop("skip_reason", "fate"), limits=limits)
    skipped = rows.groupBy("file_id").agg(F.count_if(F.col("fate") == "skipped").cast("int").alias("total_rows_skipped"), F.count_if(F.col("fate") == "dropped").cast("int").alias("total_rows_dropped"))
    size = grid.groupBy("file_id").agg(F.max("line_no").alias("records"))
    joined = layout.join(size, "file_id", "left").join(skipped, "file_id", "left").join(summarise(transactions), "file_id", "left")
    truncated = F.when(F.col("records") - F.col("header_line") > limits.max_csv_rows, F.array(F.struct(
        F.lit("row_count").alias("field"), message("truncated", rows=(F.col("records") - F.col("header_line")).cast("string"), limit=F.lit(str(limits.max_csv_rows))).alias("message")))
    ).otherwise(F.expr(f"cast(array() as {WARNING})"))
    error = (
        F.when(F.col("header").isNull(), "CSV_PARSE_ERROR").when(F.size("missing") > 0, "CSV_MISSING_REQUIRED_COLUMNS")
        .when(F.coalesce("total_rows_parsed", F.lit(0)) == 0, "CSV_NO_DATA_ROWS")
    )
    none = F.expr(f"cast(array() as {WARNING})")
    done = joined.select(
        "file_id", "currency", "statement_from", "statement_to", "opening_balance", "closing_balance",
        F.map_from_entries(F.transform("header", lambda h, i: F.struct(i, strip(h)))).alias("raw_headers"), bank_format(F.col("header")).alias("detected_format"),
        F.col("delimiter").alias("detected_delimiter"), F.col("encoding").alias("detected_encoding"), F.coalesce("total_rows_parsed", F.lit(0)).alias("total_rows_parsed"),
        F.coalesce("total_rows_skipped", F.lit(0)).alias("total_rows_skipped"), F.coalesce("total_rows_dropped", F.lit(0)).alias("total_rows_dropped"),
        F.concat(truncated, F.coalesce("warnings", none)).alias("warnings"), error.alias("error_code"), "missing",
    )
    return Statements(transactions, done, rows)


def job_status(error: Column, warnings: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(F.size(warnings) > 0, "partial").otherwise("completed")
