"""Line items are found and counted within their document, each table once, in methods that the JVM compiles."""

import re

from pyspark.sql import functions as F

from ledgermill.functions.amounts import amount_steps
from ledgermill.functions.text import with_steps
from ledgermill.operators import invoices as I

DOCS = f"file_id string, text string, tables {I.TABLES}"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_stay_where_their_document_is(spark):
    docs = spark.createDataFrame([("f", "", [[["Item", "Qty"], ["a", "1"], ["Total", "2"], ["b", "3"]]])], DOCS)
    lines = I.table_lines(docs)
    assert [(r["line_number"], r["description"]) for r in lines.orderBy("line_number").collect()] == [(1, "a"), (2, "b")]
    for found in (plan(lines), plan(I.text_lines(docs))):
        assert not re.search(r"^[ :+-]*(Window|Sort|Join|Aggregate|Repartition)", found, re.M)


def test_a_best_table_is_looked_for_once(spark):
    docs = spark.range(4).select(F.col("id").cast("string").alias("file_id"), F.array(F.array(F.array(F.lit("Item"), F.lit("Qty")), F.array(F.col("id").cast("string"), F.lit("1")))).alias("tables"))
    assert plan(I.table_lines(docs).where("quantity > 0")).count("array_max") == 1


def test_steps_break_though_their_last_column_is_unused(spark):
    texts = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in "abcde"])
    parsed = with_steps(texts, {f"p_{c}": amount_steps(F.col(c)) for c in "abcde"})
    for used in "ace":
        assert "exists(array(" in plan(parsed.select(f"p_{used}.value"))


def test_totals_name_the_first_bad_line(spark):
    rows = [("f", 7, ["unit_price"]), ("f", 3, ["quantity", "tax_rate"]), ("f", 1, []), ("g", 1, [])]
    lines = spark.createDataFrame(rows, "file_id string, line_number smallint, bad_fields array<string>").withColumn("line_total", F.lit("1.5").cast("decimal(18,4)"))
    totals = I.line_totals(lines)
    got = {r["file_id"]: (r["n_lines"], float(r["lines_sum"]), r["bad"] and tuple(r["bad"])) for r in totals.collect()}
    assert got == {"f": (3, 4.5, (3, "quantity, tax_rate")), "g": (1, 1.5, None)}
    assert "SortAggregate" not in totals._jdf.queryExecution().executedPlan().toString()


def test_text_lines_between_header_and_summary(spark):
    text = "a 1 2 3\nItem Qty Price Total\nb 1 2 3\nItem Qty Price Total\nc 4 5 6\n\nsubtotal 1 2 3\nd 1 2 3\nItem Qty Price Total\ne 1 2 3"
    docs = spark.createDataFrame([("f", text, None), ("g", "no header\nx 1 2 3", None), ("h", None, None)], DOCS)
    got = [(r["file_id"], r["line_number"], r["description"]) for r in I.text_lines(docs).orderBy("file_id", "line_number").collect()]
    assert got == [("f", 1, "b"), ("f", 2, "c")]
