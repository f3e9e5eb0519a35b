"""Views of the driver's tables as ledgers, statement files and invoices, for queries and tests.

They write typed columns as messy text; what the library reads back must be the columns again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

DELIMITERS = (",", ";", "\t", "|")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    """A double of two decimals as an exact one."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def plain(v: Column) -> Column:
    return v.cast("string")


def thousands(v: Column) -> Column:
    return F.format_number(v, 2)


def european(v: Column) -> Column:
    return F.translate(F.format_number(v, 2), ",.", ".,")


def indian(v: Column) -> Column:
    whole = F.split_part(plain(v), F.lit("."), F.lit(1))
    return F.concat(F.regexp_replace(whole, r"(\d)(?=(\d\d)+\d$)", "$1,"), F.lit("."), F.split_part(plain(v), F.lit("."), F.lit(2)))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: a statement is a customer, its rows are the orders by date, with a running balance."""
    orders = table(spark, sf_dir, "orders")
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    signed = F.when(F.col("o_orderstatus") == "F", money("o_totalprice")).otherwise(-money("o_totalprice"))
    return orders.select(
        F.col("o_custkey").cast("string").alias("file_id"), "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("transaction_date"),
        money("o_totalprice").cast("decimal(18,4)").alias("amount"), F.when(F.col("o_orderstatus") == "F", "C").otherwise("D").alias("direction"),
        F.row_number().over(order).alias("row_index"), (F.sum(signed).over(order.rowsBetween(W.unboundedPreceding, 0)) + 100_000_000).cast("decimal(18,4)").alias("balance_after"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
    )


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited text per customer: four delimiters, a preamble for every third, a blank record after
    every third row, a total at the end; amounts European where the delimiter leaves room."""
    rows = ledger(spark, sf_dir)
    kind = F.pmod("o_custkey", F.lit(4))
    mark = F.element_at(F.array(*map(F.lit, DELIMITERS)), (kind + 1).cast("int"))
    number = lambda c: F.when(kind == 1, european(money(c))).otherwise(F.concat(F.lit('"'), thousands(money(c)), F.lit('"')))
    date = F.when(kind == 1, F.date_format("transaction_date", "dd.MM.yyyy")).otherwise(F.date_format("transaction_date", "dd/MM/yyyy"))
    text = F.concat(F.lit('"Order '), F.col("o_orderkey").cast("string"), F.lit(', ref"'))
    cells = [date, text, F.when(F.col("direction") == "D", number("amount")).otherwise(""), F.when(F.col("direction") == "C", number("amount")).otherwise(""), number("balance_after")]
    line = F.concat(F.concat_ws("\u0001", *cells), F.when(F.col("row_index") % 3 == 0, "\n").otherwise(""))
    lines = rows.select("file_id", "o_custkey", "row_index", F.replace(line, F.lit("\u0001"), mark).alias("line"))
    files = lines.groupBy("file_id", "o_custkey").agg(F.sort_array(F.collect_list(F.struct("row_index", "line"))).alias("l"))
    header = F.replace(F.lit("Date\u0001Description\u0001Debit\u0001Credit\u0001Balance"), F.lit("\u0001"), mark)
    preamble = F.when(F.col("o_custkey") % 3 == 0, "Account statement\nMain branch\n\n").otherwise("")
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    total = F.concat_ws("", F.lit("Total"), mark, mark, mark, mark, F.lit("\n"))
    return files.select("file_id", "o_custkey", F.concat(preamble, header, F.lit("\n"), body, F.lit("\n"), total).alias("text"), F.lit("ascii").alias("encoding"))


def invoice_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order that has lines: text with labels, and a table of the lines.  The stated subtotal
    is the lines' sum, but 100 more for every fifth order; tax 8 %, no total for every seventh."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"), money("l_extendedprice").alias("total"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    held = lines.groupBy("l_orderkey").agg(
        F.sum("total").cast("decimal(18,2)").alias("lines_sum"), F.min("l_suppkey").alias("l_suppkey"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "qty", "total"))).alias("l"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("day"))
    joined = held.join(orders, "l_orderkey").join(supplier, "l_suppkey")
    key = F.col("l_orderkey")
    subtotal = (F.col("lines_sum") + F.when(key % 5 == 0, 100).otherwise(0)).cast("decimal(18,2)")
    tax = F.round(subtotal * F.lit("0.08").cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    said = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Total: "), F.element_at(F.array(F.lit("$"), F.lit("€"), F.lit("£")), (key % 3 + 1).cast("int")), thousands((subtotal + tax).cast("decimal(18,2)")), F.lit("\n")))
    vendor = F.when(key % 11 == 0, F.concat(F.lit("Statement\n"))).otherwise(F.concat(F.lit("Vendor: "), F.col("s_name"), F.lit("\n")))
    text = F.concat(
        vendor, F.lit("Invoice No: INV-"), key.cast("string"), F.lit("\nInvoice Date: "), F.date_format("day", "dd/MM/yyyy"), F.lit("\nSubtotal: "), thousands(subtotal),
        F.lit("\nTax: "), thousands(tax), F.lit("\n"), said,
    )
    cell = lambda x: F.array(F.concat(F.lit("Part "), x["l_partkey"].cast("string")), x["qty"].cast("string"), F.lit(""), thousands(x["total"]))
    rows = F.concat(
        F.array(F.array(*map(F.lit, ("Description", "Qty", "Unit Price", "Total")))), F.transform("l", cell),
        F.array(F.array(F.lit("Subtotal"), F.lit(""), F.lit(""), thousands(subtotal))),
    )
    note = F.array(F.array(F.lit("Terms"), F.lit("30 days")), F.array(F.lit("Note"), F.lit("-")))
    return joined.select(key.cast("string").alias("file_id"), "l_orderkey", "s_name", "day", text.alias("text"), F.array(note, rows).alias("tables"))
