"""SQL functions give what the columns give; constraints are counted in one scan of each table and one exchange."""

import re

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import sql as Sql
from ledgermill.functions.amounts import parse_amount, parse_split
from ledgermill.functions.classify import bank_format, transaction_type
from ledgermill.functions.dates import parse_date
from ledgermill.functions.text import clean_description
from ledgermill.operators.quality import violations

TEXTS = [None, "", " n/a ", "1,234.50", "1.234,5", "(12.00)", "-7", "3 cr", "€ 5", "x", "03/04/2021", "2021-02-30", "5 May 2021", "Mon 1/2/2020", "May 26", "44000", "it's \\ a\ttab", "Late fee"]


@pytest.fixture(scope="module")
def texts(spark):
    Sql.register(spark)
    return spark.createDataFrame([(i, t, TEXTS[-i]) for i, t in enumerate(TEXTS)], "i int, a string, b string")


@pytest.mark.parametrize("sql,column", [
    ("ledger_amount(a)", lambda: parse_amount(F.col("a"))), ("ledger_amount(a, 'C')", lambda: parse_amount(F.col("a"), "C")), ("ledger_split(a, b)", lambda: parse_split(F.col("a"), F.col("b"))),
    ("ledger_date(a)", lambda: parse_date(F.col("a"))), ("ledger_date_mdy(a)", lambda: parse_date(F.col("a"), False)), ("ledger_description(a)", lambda: clean_description(F.col("a"))),
    ("ledger_type(a, b, 'C')", lambda: transaction_type(F.col("a"), F.col("b"), F.lit("C"))),
    ("ledger_bank_format(array(' Description ', 'AMOUNT', a))", lambda: bank_format(F.array(F.lit(" Description "), F.lit("AMOUNT"), F.col("a")))),
])
def test_same_as_column(texts, sql, column):
    found = texts.select("i", F.expr(sql).alias("x"), column().alias("y")).orderBy("i").collect()
    assert [r["x"] for r in found] == [r["y"] for r in found]


def test_condition_and_sum(texts):
    found = texts.where("ledger_amount(a).value > 6").selectExpr("ledger_amount(a).value as v").selectExpr("sum(v) as s", "count(*) as n").first()
    want = texts.where(parse_amount(F.col("a"))["value"] > 6).agg(F.sum(parse_amount(F.col("a"))["value"]), F.count(F.lit(1))).first()
    assert tuple(found) == tuple(want) and found["n"] > 0


def test_records(texts, spark):
    text = "Date;Amount\\n\\n1/2/2021;\"5;0\"\\n; \\n"
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM ledger_records('{text}')").collect()] == [(1, ["Date", "Amount"], ";"), (3, ["1/2/2021", "5;0"], ";")]
    assert spark.sql("SELECT * FROM ledger_records('')").count() == spark.sql("SELECT * FROM ledger_records(CAST(NULL AS STRING))").count() == 0


def _tables(spark):
    vendors = spark.createDataFrame([("v1", "A"), ("v2", "A"), ("v2", None), (None, None), (None, None)], "id string, canonical_name string")
    columns = "id string, vendor_id string, confidence decimal(4,3)"
    invoices = spark.createDataFrame([("i1", "v1", None), ("i2", "gone", None), ("i3", "gone", None), ("i4", None, None)], columns)
    return {"vendors": vendors, "invoices": invoices.withColumn("confidence", F.when(F.col("id") != "i4", F.lit(2).cast("decimal(4,3)")))}


def test_violations(spark):
    found = {(r["table_name"], r["constraint_name"]): r["violations"] for r in violations(_tables(spark)).collect()}
    assert found == {
        ("vendors", "unique_id"): 1, ("vendors", "unique_canonical_name"): 1, ("invoices", "unique_id"): 0, ("invoices", "confidence"): 3, ("invoices", "fk_vendor_id"): 2,
    }


def test_violations_of_nothing(spark):
    found = violations({name: df.limit(0) for name, df in _tables(spark).items()}).collect()
    assert len(found) == 5 and all(r["violations"] == 0 for r in found)
    with pytest.raises(ValueError):
        violations({"unknown": spark.range(1)})


def test_one_scan_per_table(spark, tmp_path):
    tables = {}
    for name, df in _tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    plan = violations(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == len(tables)
