"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import config
from .config import ERROR_CODES, Limits
from .functions.amounts import amount_steps, parse_amount, parse_balance, split_steps
from .functions.classify import bank_format, transaction_type
from .functions.dates import date_steps, parse_date
from .functions import sql as Sql
from .functions.text import clean_description, from_json_array, raw_description, to_json_array, with_steps
from .operators import invoices as I, quality, statements as S, validate as V
from .plans import catalog as Cat, lenses as L
from .sources import files as Files
from .streaming import ingest as Stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _dec(c: Column) -> Column:
    return c.cast("decimal(18,4)")


# --- amounts

_AMOUNT_SQL = """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_extendedprice::DECIMAL(18,2)::DECIMAL(18,4) AS value, {direction} AS direction, {inferred} AS is_inferred FROM lineitem"""


def _price() -> Column:
    return L.money("l_extendedprice")


def _returned() -> Column:
    return F.col("l_returnflag") == "R"


for _name, _text, _direction, _inferred in (
    ("amount_standard", lambda: L.plain(_price()), "'D'", "TRUE"),
    ("amount_thousands", lambda: L.thousands(_price()), "'D'", "TRUE"),
    ("amount_european", lambda: L.european(_price()), "'D'", "TRUE"),
    ("amount_european_nothousands", lambda: F.translate(L.plain(_price()), ".", ","), "'D'", "TRUE"),
    ("amount_indian", lambda: L.indian(_price()), "'D'", "TRUE"),
    ("amount_parens", lambda: F.concat(F.lit("("), L.thousands(_price()), F.lit(")")), "'D'", "FALSE"),
    ("amount_suffix_drcr", lambda: F.concat(L.plain(_price()), F.when(_returned(), " CR").otherwise(" Dr ")), "CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'D' END", "FALSE"),
    ("amount_symbol", lambda: F.concat(F.when(_returned(), "€ ").otherwise("₹"), L.plain(_price())), "'D'", "TRUE"),
    ("amount_negative", lambda: F.concat(F.when(_returned(), "-$").otherwise("-"), L.thousands(_price())), "'D'", "FALSE"),
):
    def _amounts(spark: SparkSession, sf_dir: str, text: Callable[[], Column] = _text) -> DataFrame:
        texts = L.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), text().alias("text"))
        parsed = with_steps(texts, {"p": amount_steps(F.col("text"))})
        return parsed.select("l_orderkey", "line", _dec(F.col("p.value")).alias("value"), "p.direction", "p.is_inferred")

    query(_name, _AMOUNT_SQL.format(direction=_direction, inferred=_inferred))(_amounts)


@query("amount_null_tokens", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_linenumber = 7 AS found FROM lineitem")
def _(spark, sf_dir):
    tokens = F.array(*map(F.lit, ("", "-", " N/A ", "nil", "0.00", "None", "0")))
    text = F.element_at(tokens, F.least("l_linenumber", F.lit(7)))
    return L.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), parse_amount(text).isNotNull().alias("found"))


@query("amount_invalid", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_linenumber <= 5 AS error, CASE WHEN l_linenumber > 5 THEN l_orderkey::DECIMAL(18,4) END AS value FROM lineitem")
def _(spark, sf_dir):
    key = F.col("l_orderkey").cast("string")
    forms = F.array(F.lit("not-a-number"), F.concat(key, F.lit("DR")), F.concat(key, F.lit(" USD")), F.lit("1.234.567"), F.concat(F.lit("$("), key, F.lit(")")), key, key)
    parsed = L.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), parse_amount(F.element_at(forms, F.least("l_linenumber", F.lit(7)))).alias("p"))
    return parsed.select("l_orderkey", "line", "p.error", _dec(F.col("p.value")).alias("value"))


@query("amount_split", """SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) AS value, CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'D' END AS direction, o_orderstatus = 'P' AS warned FROM orders""")
def _(spark, sf_dir):
    price, status = L.thousands(L.money("o_totalprice")), F.col("o_orderstatus")
    sides = L.table(spark, sf_dir, "orders").select("o_orderkey", F.when(status != "F", price).alias("debit"), F.when(status == "F", price).when(status == "P", "1.00").otherwise("").alias("credit"))
    parsed = with_steps(sides, {"p": split_steps(F.col("debit"), F.col("credit"))})
    return parsed.select("o_orderkey", _dec(F.col("p.value")).alias("value"), "p.direction", F.col("p.warning").isNotNull().alias("warned"))


@query("balance_parse", """SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN NULL ELSE abs(c_acctbal::DECIMAL(18,2))::DECIMAL(18,4) END AS balance FROM customer""")
def _(spark, sf_dir):
    return L.table(spark, sf_dir, "customer").select("c_custkey", _dec(parse_balance(L.thousands(L.money("c_acctbal")))).alias("balance"))


# --- dates

_DAY = "o_orderdate"
for _name, _text, _where, _sql_where in (
    ("date_iso", lambda: F.date_format(_DAY, "yyyy-MM-dd"), None, "TRUE"),
    ("date_dmy", lambda: F.date_format(_DAY, "dd/MM/yyyy"), None, "TRUE"),
    ("date_mdy_swap", lambda: F.date_format(_DAY, "MM/dd/yyyy"), lambda: F.dayofmonth(_DAY) > 12, "day(o_orderdate) > 12"),
    ("date_month_name", lambda: F.when(F.col("o_orderkey") % 2 == 0, F.date_format(_DAY, "MMM d, yyyy")).otherwise(F.date_format(_DAY, "dd-MMMM-yyyy")), None, "TRUE"),
    ("date_timestamp", lambda: F.when(F.col("o_orderkey") % 2 == 0, F.date_format(_DAY, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(_DAY, "dd.MM.yyyy HH:mm")), None, "TRUE"),
    ("date_short_year", lambda: F.date_format(_DAY, "dd/MM/yy"), None, "TRUE"),
):
    def _dates(spark: SparkSession, sf_dir: str, text: Callable[[], Column] = _text, where: Callable[[], Column] | None = _where) -> DataFrame:
        orders = L.table(spark, sf_dir, "orders")
        orders = orders if where is None else orders.where(where())
        parsed = with_steps(orders.select("o_orderkey", text().alias("text")), {"p": date_steps(F.col("text"))})
        return parsed.select("o_orderkey", F.col("p.value").alias("day"))

    query(_name, f"SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE {_sql_where}")(_dates)


@query("date_mdy_all", "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate::DATE END AS day FROM orders")
def _(spark, sf_dir):
    parsed = with_steps(L.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(_DAY, "MM/dd/yyyy").alias("text")), {"p": date_steps(F.col("text"))})
    return parsed.select("o_orderkey", F.col("p.value").alias("day"))


@query("date_excel_serial", "SELECT o_orderkey, o_orderdate::DATE AS day, TRUE AS serial FROM orders")
def _(spark, sf_dir):
    text = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    parsed = with_steps(L.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), {"p": date_steps(F.col("text"))})
    return parsed.select("o_orderkey", F.col("p.value").alias("day"), F.col("p.is_excel_serial").alias("serial"))


@query("date_null_tokens", "SELECT o_orderkey, o_orderkey % 5 = 4 AS error FROM orders")
def _(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("", "-", " TBD", "pending", "31/02/2026"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    parsed = with_steps(L.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), {"p": date_steps(F.col("text"))})
    return parsed.select("o_orderkey", F.coalesce("p.error", F.lit(False)).alias("error"))


@query("date_ambiguity", "SELECT o_orderkey, day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders")
def _(spark, sf_dir):
    parsed = with_steps(L.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("text")), {"p": date_steps(F.col("text"))})
    return parsed.select("o_orderkey", F.col("p.is_ambiguous").alias("ambiguous"))


# --- statements: rendered as files and read back

_LEDGER_SQL = """
WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'D' END AS direction,
  row_number() OVER w AS i, (sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * o_totalprice::DECIMAL(18,2)) OVER w + 100000000)::DECIMAL(18,4) AS balance,
  CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 1 END AS header, substr(o_orderpriority, 1, 1) AS priority
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS (SELECT *, (header + i + (i - 1) // 3)::BIGINT AS row_index FROM t)
"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = L.statement_files(spark, sf_dir)
    return files.select("file_id", "encoding"), Files.staged(Files.tokenise(files), "grid")


def _parsed(spark: SparkSession, sf_dir: str) -> S.Statements:
    files, grid = _grid(spark, sf_dir)
    return S.parse(grid, files, stage=lambda rows: Files.staged(rows, "rows"))


def _rows(spark: SparkSession, sf_dir: str, limits: Limits = config.LIMITS) -> DataFrame:
    _, grid = _grid(spark, sf_dir)
    return S.data_rows(grid, S.layouts(grid), limits.max_csv_rows)


@query("csv_roundtrip", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, row_index, day, amount, direction, balance, 'Order ' || o_orderkey || ', ref' AS description FROM l")
def _(spark, sf_dir):
    t = S.parse_rows(_rows(spark, sf_dir).where("skip_reason is null")).where("transaction_date is not null")
    return t.select("file_id", F.col("row_index").cast("long").alias("row_index"), F.col("transaction_date").alias("day"), "amount", "direction", F.col("balance_after").alias("balance"), "description")


@query("csv_header_discovery", "SELECT DISTINCT o_custkey::VARCHAR AS file_id, (CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 1 END)::BIGINT AS header_line FROM orders")
def _(spark, sf_dir):
    return S.layouts(_grid(spark, sf_dir)[1]).select("file_id", F.col("header_line").cast("long").alias("header_line"))


@query("csv_delimiter", "SELECT DISTINCT o_custkey::VARCHAR AS file_id, CASE o_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM orders")
def _(spark, sf_dir):
    return S.layouts(_grid(spark, sf_dir)[1]).select("file_id", "delimiter")


@query("csv_column_mapping", "SELECT DISTINCT o_custkey::VARCHAR AS file_id, '0,1,2,3,4' AS columns, 0::BIGINT AS n_missing FROM orders")
def _(spark, sf_dir):
    found = S.layouts(_grid(spark, sf_dir)[1])
    order = F.concat_ws(",", *[F.col(f"columns.{c}").cast("string") for c in ("date", "description", "debit", "credit", "balance")])
    return found.select("file_id", order.alias("columns"), F.size("missing").cast("long").alias("n_missing"))


@query("csv_row_filter", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, count(*) AS n_rows, count(*) // 3 AS n_blank, 1::BIGINT AS n_summary FROM l GROUP BY o_custkey")
def _(spark, sf_dir):
    count = lambda c, n: F.count_if(c).alias(n)
    why = F.col("skip_reason")
    return _rows(spark, sf_dir).groupBy("file_id").agg(count(why.isNull(), "n_rows"), count(why == "blank_row", "n_blank"), count(why == "summary_row", "n_summary"))


@query("csv_row_limit", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, count(*) AS n_rows FROM l WHERE i + (i - 1) // 3 <= 5 GROUP BY o_custkey")
def _(spark, sf_dir):
    return _rows(spark, sf_dir, Limits(max_csv_rows=5)).where("skip_reason is null").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("csv_row_index", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, max(row_index) AS last_row, sum(row_index)::BIGINT AS row_sum FROM l GROUP BY o_custkey")
def _(spark, sf_dir):
    return _rows(spark, sf_dir).where("skip_reason is null").groupBy("file_id").agg(F.max("line_no").cast("long").alias("last_row"), F.sum("line_no").alias("row_sum"))


@query("statement_summary", _LEDGER_SQL + """SELECT o_custkey::VARCHAR AS file_id, min(day) AS statement_from, max(day) AS statement_to, arg_min(balance, i) AS opening_balance, arg_max(balance, i) AS closing_balance,
  count(*) AS n_parsed, count(*) // 3 + 1 AS n_skipped, 'GENERIC_SPLIT' AS detected_format FROM l GROUP BY o_custkey""")
def statement_summary(spark, sf_dir):
    done = _parsed(spark, sf_dir).statements
    return done.select("file_id", "statement_from", "statement_to", "opening_balance", "closing_balance", F.col("total_rows_parsed").cast("long").alias("n_parsed"), F.col("total_rows_skipped").cast("long").alias("n_skipped"), "detected_format")


@query("row_accounting", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, count(*) + count(*) // 3 + 1 AS n_rows, count(*) AS n_parsed, count(*) // 3 + 1 AS n_skipped, 0::BIGINT AS n_dropped FROM l GROUP BY o_custkey")
def _(spark, sf_dir):
    rows = _parsed(spark, sf_dir).rows.groupBy("file_id")
    count = lambda f: F.count_if(F.col("fate") == f)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), count("parsed").alias("n_parsed"), count("skipped").alias("n_skipped"), count("dropped").alias("n_dropped"))


@query("warnings_rollup", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, count(*) FILTER (WHERE day(day) <= 12 AND day(day) <> month(day)) AS n_warnings, CASE WHEN count(*) FILTER (WHERE day(day) <= 12 AND day(day) <> month(day)) > 0 THEN 'partial' ELSE 'completed' END AS status, "
       "coalesce(string_agg('row_' || row_index, ',' ORDER BY row_index) FILTER (WHERE day(day) <= 12 AND day(day) <> month(day)), '') AS fields FROM l GROUP BY o_custkey")
def _(spark, sf_dir):
    done = _parsed(spark, sf_dir).statements
    fields = F.array_join(F.transform("warnings", lambda w: w["field"]), ",")
    return done.select("file_id", F.size("warnings").cast("long").alias("n_warnings"), S.job_status(F.col("error_code"), F.col("warnings")).alias("status"), fields.alias("fields"))


@query("job_status", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'failed' WHEN c_custkey % 3 = 1 THEN 'partial' ELSE 'completed' END AS status FROM customer")
def _(spark, sf_dir):
    key = F.col("c_custkey") % 3
    return L.table(spark, sf_dir, "customer").select("c_custkey", S.job_status(F.when(key == 0, "CSV_PARSE_ERROR"), F.when(key == 1, F.array(F.lit("w"))).otherwise(F.expr("cast(array() as array<string>)"))).alias("status"))


@query("required_columns", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'date' WHEN 2 THEN 'amount (or debit/credit)' ELSE 'date,amount (or debit/credit)' END AS missing FROM customer")
def _(spark, sf_dir):
    forms = F.array(*[F.array(*map(F.lit, h)) for h in (("Datum", "Betrag"), ("Narration", "Withdrawal Amt (Dr)"), ("Value Dt", "Narration"), ("Narration", "Balance"))])
    grid = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file_id"), F.lit(1).alias("line_no"), F.element_at(forms, (F.col("c_custkey") % 4 + 1).cast("int")).alias("cells"), F.lit(",").alias("delimiter"))
    return S.layouts(grid).select(F.col("file_id").cast("long").alias("c_custkey"), F.array_join("missing", ",").alias("missing"))


@query("no_data_rows", "SELECT DISTINCT o_custkey::VARCHAR AS file_id, 'CSV_NO_DATA_ROWS' AS error_code FROM orders")
def _(spark, sf_dir):
    files, grid = _grid(spark, sf_dir)
    return S.parse(grid, files, Limits(max_csv_rows=0)).statements.select("file_id", "error_code")


def _currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "USD", "2", "EUR", "3", "GBP", "4", "INR")]), F.when(F.col("priority") != "5", F.col("priority")))
    rows = L.ledger(spark, sf_dir).withColumns({"currency": code, "parse_warnings": F.expr("cast(array() as array<string>)")})
    return S.summarise(S.with_continuity(rows))


_CURRENCY_SQL = _LEDGER_SQL + ", c AS (SELECT o_custkey, CASE priority WHEN '1' THEN 'USD' WHEN '2' THEN 'EUR' WHEN '3' THEN 'GBP' WHEN '4' THEN 'INR' END AS cur FROM l) "


@query("dominant_currency", _CURRENCY_SQL + ", n AS (SELECT o_custkey, cur, count(*) AS k FROM c WHERE cur IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, cur) AS q FROM n) "
       "SELECT DISTINCT c.o_custkey::VARCHAR AS file_id, r.cur AS currency FROM c LEFT JOIN r ON c.o_custkey = r.o_custkey AND q = 1")
def _(spark, sf_dir):
    return _currencies(spark, sf_dir).select("file_id", "currency")


@query("multi_currency", _CURRENCY_SQL + "SELECT o_custkey::VARCHAR AS file_id, coalesce(string_agg(DISTINCT cur, ',' ORDER BY cur), '') AS currencies, count(DISTINCT cur) > 1 AS warned FROM c GROUP BY o_custkey")
def _(spark, sf_dir):
    return _currencies(spark, sf_dir).select("file_id", F.array_join("currencies", ",").alias("currencies"), F.exists("warnings", lambda w: w["field"] == "currency").alias("warned"))


_GAP_SQL = _LEDGER_SQL + """, k AS (SELECT * FROM l WHERE i % 7 <> 0), g AS (SELECT *, lag(balance) OVER (PARTITION BY o_custkey ORDER BY i) AS before,
  lag(balance) OVER (PARTITION BY o_custkey ORDER BY i) + CASE WHEN direction = 'C' THEN amount ELSE -amount END AS expected FROM k) """


@query("balance_continuity", _GAP_SQL + "SELECT o_custkey::VARCHAR AS file_id, i AS row_index, expected::DECIMAL(18,4) AS expected, abs(expected - balance)::DECIMAL(18,4) AS gap FROM g WHERE abs(expected - balance) > 0.10")
def _(spark, sf_dir):
    found = S.with_continuity(L.ledger(spark, sf_dir).where("row_index % 7 <> 0")).where("balance_gap is not null")
    return found.select("file_id", F.col("row_index").cast("long").alias("row_index"), F.col("expected_balance").alias("expected"), F.col("balance_gap").alias("gap"))


@query("balance_gate", _GAP_SQL + ", s AS (SELECT o_custkey, bool_or(i = 5) AS hole FROM k GROUP BY 1) SELECT g.o_custkey::VARCHAR AS file_id, count(*) FILTER (WHERE abs(expected - balance) > 0.10 AND NOT hole) AS n_gaps FROM g JOIN s USING (o_custkey) GROUP BY 1")
def _(spark, sf_dir):
    rows = L.ledger(spark, sf_dir).where("row_index % 7 <> 0").withColumn("balance_after", F.when(F.col("row_index") != 5, F.col("balance_after")))
    return S.with_continuity(rows).groupBy("file_id").agg(F.count("balance_gap").alias("n_gaps"))


# --- text and classification

@query("txn_classification", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'transfer' WHEN 1 THEN 'fee' WHEN 2 THEN 'interest' WHEN 3 THEN 'debit' WHEN 4 THEN 'credit' WHEN 5 THEN 'fee' WHEN 6 THEN 'transfer'
  ELSE CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END END AS kind FROM orders""")
def _(spark, sf_dir):
    n = (F.col("o_orderkey") % 8 + 1).cast("int")
    text = F.element_at(F.array(*map(F.lit, ("NEFT payment fee", "Late Charge", "int paid march", "ATM 42", "Salary", "coffee", "upi interest", "coffee shop"))), n)
    explicit = F.when(n == 6, " FEE ").otherwise("other")
    direction = F.when(F.col("o_orderstatus") == "F", "C").otherwise("D")
    return L.table(spark, sf_dir, "orders").select("o_orderkey", transaction_type(explicit, text, direction).alias("kind"))


@query("description_clean", "SELECT p_partkey, p_name AS description, chr(9) || ' ' || replace(p_name, ' ', chr(10) || ' ') || ' ' AS raw FROM part")
def _(spark, sf_dir):
    messy = F.concat(F.lit("\t "), F.replace("p_name", F.lit(" "), F.lit("\n ")), F.lit(" "))
    clean = clean_description(messy)
    return L.table(spark, sf_dir, "part").select("p_partkey", clean.alias("description"), raw_description(messy, clean).alias("raw"))


@query("bank_format", "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'HDFC_STANDARD' WHEN 1 THEN 'ICICI_STANDARD' WHEN 2 THEN 'SBI_STANDARD' WHEN 3 THEN 'CHASE_US' WHEN 4 THEN 'GENERIC_SPLIT' WHEN 5 THEN 'GENERIC_SINGLE' ELSE 'UNKNOWN' END AS fmt FROM customer")
def _(spark, sf_dir):
    forms = ("Date|Narration|Chq./Ref.No.", "Date|Transaction Remarks|Amount", "Date|Particulars|Cheque No", "Memo|Amount|Description", "Date| Description |DEBIT|Credit", "Description|Amount", "Datum|Betrag")
    headers = F.element_at(F.array(*[F.array(*map(F.lit, f.split("|"))) for f in forms]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return L.table(spark, sf_dir, "customer").select("c_custkey", bank_format(headers).alias("fmt"))


# --- files

@query("encoding_detect", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'utf-8-sig' WHEN doc_id % 4 = 1 THEN 'latin-1' WHEN regexp_full_match(text, '[\\x00-\\x7f]*', 's') THEN 'ascii' ELSE 'utf-8' END AS encoding, "
       "sha256(CASE WHEN doc_id % 4 = 1 THEN 'é,' || doc_id ELSE text END) AS text_sha256 FROM documents")
def _(spark, sf_dir):
    kind, utf8 = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(kind == 1, F.concat(F.unhex(F.lit("E92C")), F.encode(F.col("doc_id").cast("string"), "UTF-8"))).otherwise(utf8)
    found = L.table(spark, sf_dir, "documents").select("doc_id", Files.decoded(content).alias("x"))
    return found.select("doc_id", "x.encoding", F.sha2("x.text", 256).alias("text_sha256"))


def _doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("in box/file "), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".csv", ".PDF", ".txt", ".xlsx"))), (F.col("doc_id") % 4 + 1).cast("int")))
    content = F.encode("text", "UTF-8")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file_id"), name.alias("original_name"), F.octet_length(content).cast("long").alias("length"), content.alias("content"), F.lit("2026-01-01").cast("timestamp").alias("uploaded_at"))


@query("checksum_dedup", "SELECT sha256(text) AS checksum, lpad(min(doc_id)::VARCHAR, 12, '0') AS first_file, count(*) AS n_files FROM documents GROUP BY 1")
def _(spark, sf_dir):
    files = _doc_files(spark, sf_dir).select("file_id", V.checksum(F.col("content")).alias("checksum"))
    return files.groupBy("checksum").agg(F.min("file_id").alias("first_file"), F.count(F.lit(1)).alias("n_files"))


_KNOWN = "SELECT sha256(text) AS checksum FROM documents WHERE doc_id % 5 = 0 GROUP BY 1"


@query("duplicate_lookup", f"SELECT doc_id, sha256(text) IN ({_KNOWN}) AS known FROM documents")
def _(spark, sf_dir):
    docs = L.table(spark, sf_dir, "documents").select("doc_id", V.checksum(F.encode("text", "UTF-8")).alias("checksum"))
    known = docs.where("doc_id % 5 = 0").select("checksum").distinct()
    semi, anti = docs.join(known, "checksum", "left_semi"), docs.join(known, "checksum", "left_anti")
    return semi.select("doc_id", F.lit(True).alias("known")).unionByName(anti.select("doc_id", F.lit(False).alias("known")))


@query("error_codes_of_files", """WITH f AS (SELECT *, lpad(doc_id::VARCHAR, 12, '0') AS file_id, octet_length(encode(text)) AS n, min(doc_id) OVER (PARTITION BY text) AS first, doc_id % 4 AS k,
  regexp_matches(decode(encode(text)[1:1024]), '[\\n,;]') AS plain FROM documents WHERE TRUE)
  SELECT file_id, CASE WHEN k = 2 THEN 'INVALID_EXTENSION' WHEN n = 0 THEN 'EMPTY_FILE' WHEN first <> doc_id THEN 'DUPLICATE_FILE' WHEN k = 1 OR k = 3 THEN 'FILE_TYPE_MISMATCH' WHEN n < 10 THEN 'CSV_PARSE_ERROR' ELSE 'ok' END AS code
  FROM f""")
def _(spark, sf_dir):
    padded = _doc_files(spark, sf_dir).withColumn("content", F.concat(F.unhex(F.lit("EFBBBF")), F.col("content")))  # a mark makes any text text
    return V.validate(padded, twins="any").select("file_id", F.coalesce("error_code", F.lit("ok")).alias("code"))


@query("filename_sanitise", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '[^/]*$'), '[^a-zA-Z0-9._\\-]', '_', 'g'), ''), 'upload') AS name FROM pages")
def _(spark, sf_dir):
    return L.table(spark, sf_dir, "pages").select("page_id", V.safe_name(F.col("url")).alias("name"))


@query("extension_check", "SELECT p_partkey, '.' || (['csv', 'pdf', 'xlsx', 'txt'])[p_partkey % 4 + 1] AS ext, p_partkey % 4 < 3 AS allowed FROM part")
def _(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, (".CSV", ".pdf", ".v2.XlsX", ".txt"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return L.table(spark, sf_dir, "part").select("p_partkey", V.extension(name).alias("ext"), V.extension(name).isin(*config.EXTENSIONS).alias("allowed"))


@query("mime_detect", """SELECT p_partkey, (['application/pdf', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'application/zip', 'text/plain', 'text/plain', 'application/octet-stream', 'text/plain', 'application/octet-stream'])[p_partkey % 8 + 1] AS mime FROM part""")
def _(spark, sf_dir):
    heads = [F.unhex(F.lit(h)) for h in (b"%PDF-1.7".hex(), b"PK\3\4..xl/workbook".hex(), b"PK\3\4plain".hex(), "fffe410042", "efbbbf41", "ff00ff", b"a;b".hex(), b"abc".hex())]
    return L.table(spark, sf_dir, "part").select("p_partkey", V.mime(F.element_at(F.array(*heads), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("mime"))


@query("error_codes", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {s}, '{g}')" for c, s, g in ERROR_CODES) + ") AS t(code, http_status, stage)")
def _(spark, sf_dir):
    return spark.createDataFrame(list(ERROR_CODES), "code string, http_status int, stage string")


@query("scanned_pages", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 THEN '1,3' ELSE '3' END AS scanned FROM documents")
def _(spark, sf_dir):
    pages = F.array("text", F.lit("long enough " * 6), F.lit(None).cast("string"))
    return L.table(spark, sf_dir, "documents").select("doc_id", F.array_join(V.scanned_pages(pages), ",").alias("scanned"))


# --- catalog

def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = L.table(spark, sf_dir, "events")
    return kinds.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))


@query("latest_job", "SELECT document_id, id, status FROM (SELECT user_id::VARCHAR AS document_id, event_id::VARCHAR AS id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS k FROM events) WHERE k = 1")
def _(spark, sf_dir):
    return Cat.latest_jobs(_jobs(spark, sf_dir)).select("document_id", "id", "status")


_DOCS = "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'invoice' ELSE 'bank_statement' END AS document_type, doc_id % 9 = 0 AS gone, TIMESTAMP '2026-01-01' + INTERVAL 1 SECOND * (doc_id % 100) AS uploaded FROM documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return L.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("id"), F.when(n % 2 == 0, "invoice").otherwise("bank_statement").alias("document_type"), (n % 9 == 0).alias("is_deleted"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:00:00")) + n % 100).alias("uploaded_at"), V.checksum(F.encode("text", "UTF-8")).alias("checksum_sha256"),
        F.when(n % 9 == 0, F.lit("2026-02-01").cast("timestamp")).alias("deleted_at"),
    )


@query("list_documents", f"WITH d AS ({_DOCS}) SELECT id, document_type FROM d WHERE NOT gone AND document_type = 'invoice' ORDER BY uploaded DESC, id LIMIT 20 OFFSET 10")
def _(spark, sf_dir):
    found = _documents(spark, sf_dir).where((~F.col("is_deleted")) & (F.col("document_type") == "invoice"))
    return Cat.page(found, 20, 10).select("id", "document_type")


@query("soft_delete_filter", f"WITH d AS ({_DOCS}) SELECT document_type, count(*) AS n FROM d WHERE NOT gone GROUP BY 1")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).where("not is_deleted").groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier = L.table(spark, sf_dir, "supplier")
    vendors = supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("canonical_name"))
    return supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.lower("s_name")).alias("name")), vendors


@query("vendor_resolve", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE lower(s_name) END AS name, s_suppkey::VARCHAR AS vendor_id FROM supplier WHERE s_suppkey % 3 <> 0")
def _(spark, sf_dir):
    return Cat.resolve_vendors(*_names(spark, sf_dir))[0].select("name", "vendor_id")


@query("vendor_new", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE lower(s_name) END AS canonical_name FROM supplier WHERE s_suppkey % 3 = 0")
def _(spark, sf_dir):
    return Cat.resolve_vendors(*_names(spark, sf_dir))[1].select("canonical_name")


@query("document_job_join", "SELECT event_type AS status, count(*) AS n, count(DISTINCT d.doc_id) AS n_documents FROM documents d JOIN events e ON e.user_id = d.doc_id GROUP BY 1")
def _(spark, sf_dir):
    joined = Cat.with_jobs(_documents(spark, sf_dir).select("id"), _jobs(spark, sf_dir).drop("id"))
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("n_documents"))


@query("statement_transactions_join", "SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,4) AS amount FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf_dir):
    statements = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    joined = Cat.with_parent(L.ledger(spark, sf_dir).select(F.col("o_custkey").alias("bank_statement_id"), "amount"), statements, "bank_statement_id")
    return joined.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), _dec(F.sum("amount")).alias("amount"))


@query("invoice_lines_join", "SELECT o_orderpriority AS priority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_invoices, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,4) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf_dir):
    invoices = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    joined = Cat.with_parent(L.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), L.money("l_extendedprice").alias("v")), invoices, "invoice_id")
    return joined.groupBy("priority").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("invoice_id").alias("n_invoices"), _dec(F.sum("v")).alias("total"))


@query("invoice_vendor_left", "SELECT s_name AS vendor, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON l_suppkey = s_suppkey GROUP BY 1")
def _(spark, sf_dir):
    vendors = L.table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("vendor"))
    lines = L.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("vendor_id")).count()
    return Cat.with_parent(lines, vendors, "vendor_id", "left").groupBy("vendor").agg(F.sum("count").alias("n"))


@query("orphan_check", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf_dir):
    return quality.orphans(L.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", L.table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


@query("document_tags", "SELECT doc_id::VARCHAR AS id, 'lang=' || lang || ';source=' || source AS tags FROM documents")
def _(spark, sf_dir):
    docs = L.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "source")
    made = docs.select(F.col("id").alias("document_id"), F.expr("stack(2, 'lang', lang, 'source', source) as (key, value)"))
    found = Cat.tags(docs.select("id"), made)
    return found.select("id", F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("tags"))


@query("nested_statement", "SELECT c_custkey::VARCHAR AS id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(spark, sf_dir):
    parents = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    found = Cat.nested(parents, L.ledger(spark, sf_dir).select("file_id", "row_index", "o_orderkey"), "file_id", "row_index", "transactions")
    return found.select("id", F.array_join(F.transform("transactions", lambda t: t["o_orderkey"].cast("string")), ",").alias("orders"))


@query("dq_constraints", """SELECT 'bank_transactions' AS table_name, 'amount' AS constraint_name, count(*) FILTER (WHERE c_acctbal < 0) AS violations FROM customer
  UNION ALL SELECT 'bank_transactions', 'direction', count(*) FILTER (WHERE c_custkey % 13 = 0) FROM customer UNION ALL SELECT 'bank_transactions', 'date', 0 UNION ALL SELECT 'bank_transactions', 'transaction_type', 0
  UNION ALL SELECT 'bank_transactions', 'unique_id', 0 UNION ALL SELECT 'bank_transactions', 'unique_bank_statement_id_row_index', count(*) FROM (SELECT c_nationkey, c_custkey % 50 FROM customer GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'bank_statements', 'unique_id', 0 UNION ALL SELECT 'bank_transactions', 'fk_bank_statement_id', count(*) FILTER (WHERE c_nationkey = 3) FROM customer""")
def _(spark, sf_dir):
    rows = L.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("bank_statement_id"), (F.col("c_custkey") % 50).cast("int").alias("row_index"), L.money("c_acctbal").alias("amount"),
        F.when(F.col("c_custkey") % 13 == 0, "X").otherwise("C").alias("direction"), F.lit("2026-01-01").cast("date").alias("transaction_date"), F.lit("credit").alias("transaction_type"),
    )
    parents = L.table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("string").alias("id"))
    return quality.violations({"bank_transactions": rows, "bank_statements": parents})


# --- invoices

_INVOICE_SQL = """
WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice::DECIMAL(18,2)) AS s, min(l_suppkey) AS sk, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT k, n, s::DECIMAL(18,4) AS lines_sum, (s + CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END)::DECIMAL(18,2) AS subtotal, s_name, o_orderdate::DATE AS day FROM l JOIN orders ON k = o_orderkey JOIN supplier ON sk = s_suppkey),
i AS (SELECT *, round(subtotal * 0.08::DECIMAL(4,2), 2)::DECIMAL(18,2) AS tax FROM d)
"""


@query("invoice_fields", _INVOICE_SQL + "SELECT k::VARCHAR AS file_id, 'INV-' || k AS invoice_number, day AS invoice_date, subtotal::DECIMAL(18,4) AS subtotal, tax::DECIMAL(18,4) AS tax_amount, (CASE WHEN k % 7 = 0 THEN NULL ELSE subtotal + tax END)::DECIMAL(18,4) AS total_amount FROM i")
def _(spark, sf_dir):
    found = I.fields(L.invoice_docs(spark, sf_dir).select("file_id", "text"))
    return found.select("file_id", "invoice_number", "invoice_date", "subtotal", "tax_amount", "total_amount")


@query("invoice_currency_vote", _INVOICE_SQL + "SELECT k::VARCHAR AS file_id, CASE WHEN k % 7 = 0 OR k % 3 = 0 THEN 'USD' WHEN k % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency FROM i")
def _(spark, sf_dir):
    return L.invoice_docs(spark, sf_dir).select("file_id", I.currency_vote(F.col("text")).alias("currency"))


@query("invoice_vendor", _INVOICE_SQL + "SELECT k::VARCHAR AS file_id, CASE WHEN k % 11 = 0 THEN NULL ELSE s_name END AS vendor FROM i")
def _(spark, sf_dir):
    docs = L.invoice_docs(spark, sf_dir)
    text = F.when(F.col("l_orderkey") % 11 == 0, F.lit("Statement\nTotal: 5\n12345678\n")).otherwise(F.col("text"))
    return docs.select("file_id", I.vendor_name(text).alias("vendor"))


@query("invoice_confidence", _INVOICE_SQL + "SELECT k::VARCHAR AS file_id, (1.00 - CASE WHEN k % 7 = 0 THEN 0.15 ELSE 0 END)::DECIMAL(18,4) AS confidence FROM i")
def _(spark, sf_dir):
    text = F.concat(F.lit("Vendor: Some Name\n"), F.col("text"))
    return I.fields(L.invoice_docs(spark, sf_dir).select("file_id", text.alias("text"))).select("file_id", _dec(F.col("confidence")).alias("confidence"))


@query("invoice_lines", """SELECT l_orderkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_extendedprice)::BIGINT AS line_number,
  'Part ' || l_partkey AS description, l_quantity::INT::DECIMAL(18,4) AS quantity, l_extendedprice::DECIMAL(18,2)::DECIMAL(18,4) AS line_total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey""")
def _(spark, sf_dir):
    lines = I.table_lines(L.invoice_docs(spark, sf_dir).select("file_id", "tables"))
    return lines.select("file_id", F.col("line_number").cast("long").alias("line_number"), "description", _dec(F.col("quantity")).alias("quantity"), "line_total")


@query("line_inference", "SELECT l_orderkey::VARCHAR || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS file_id, (l_quantity::INT * l_tax::DECIMAL(18,2))::DECIMAL(18,4) AS line_total FROM lineitem")
def _(spark, sf_dir):
    item = L.table(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    row = F.array(F.lit("Widget"), F.col("l_quantity").cast("int").cast("string"), F.concat(F.lit("$"), L.plain(F.greatest(L.money("l_tax"), F.lit(0).cast("decimal(18,2)")))), F.lit(""))
    # A price of 0.00 is no price; such lines have a price cell of 0 instead.
    row = F.transform(row, lambda c: F.when(c == "$0.00", "0").otherwise(c))
    docs = item.select(key.alias("file_id"), F.array(F.array(F.array(*map(F.lit, ("Item", "Qty", "Rate", "Amount"))), row)).alias("tables"))
    return I.table_lines(docs).select("file_id", "line_total")


@query("invoice_text_lines", """SELECT l_orderkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_extendedprice)::BIGINT AS line_number, 'Part no ' || l_partkey AS description,
  l_quantity::INT::DECIMAL(18,4) AS quantity, l_extendedprice::DECIMAL(18,2)::DECIMAL(18,4) AS line_total FROM lineitem""")
def _(spark, sf_dir):
    item = L.table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", F.lit("Part no"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("$1.00"), L.thousands(L.money("l_extendedprice")))
    held = item.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_extendedprice", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("Widgets 1 2 3\n\nDescription  Qty  Price  Total\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"), F.lit("\nSubtotal 1 2 3\nAfter 1 2 3\n"))
    lines = I.text_lines(held.select(F.col("l_orderkey").cast("string").alias("file_id"), text.alias("text")))
    return lines.select("file_id", F.col("line_number").cast("long").alias("line_number"), "description", _dec(F.col("quantity")).alias("quantity"), "line_total")


@query("invoice_reconcile", _INVOICE_SQL + "SELECT k::VARCHAR AS file_id, n AS n_lines, lines_sum, (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_notes FROM i")
def _(spark, sf_dir):
    docs = Files.staged(L.invoice_docs(spark, sf_dir).select("file_id", "text", "tables"), "invoices")
    invoices, lines = I.fields(docs.select("file_id", "text")), I.table_lines(docs.select("file_id", "tables"))
    found = I.reconcile(invoices, I.line_totals(lines))
    return found.select("file_id", F.col("n_lines").cast("long").alias("n_lines"), "lines_sum", F.size("reconciliation").cast("long").alias("n_notes"))


@query("invoice_parse", _INVOICE_SQL + "SELECT k::VARCHAR AS file_id, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'partial' ELSE 'completed' END AS status, n AS n_lines FROM i")
def _(spark, sf_dir):
    found, _ = I.parse(Files.staged(L.invoice_docs(spark, sf_dir).select("file_id", "text", "tables"), "invoices"))
    return found.select("file_id", S.job_status(F.col("error_code"), F.col("warnings")).alias("status"), F.col("n_lines").cast("long").alias("n_lines"))


# --- results beside documents, page counts, extractors' answers, arrays as text

@query("document_results_join", """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 1 THEN c_custkey::VARCHAR END AS statement_id, CASE WHEN doc_id % 2 = 0 THEN s_suppkey::VARCHAR END AS invoice_id,
  CASE WHEN doc_id % 2 = 1 AND c_custkey IS NOT NULL THEN 'EUR' WHEN doc_id % 2 = 0 AND s_suppkey IS NOT NULL THEN 'USD' END AS currency
  FROM documents LEFT JOIN customer ON c_custkey = doc_id LEFT JOIN supplier ON s_suppkey = doc_id""")
def _(spark, sf_dir):
    of = lambda t, key, odd, currency: L.table(spark, sf_dir, t).where(F.col(key) % 2 == odd).select(F.col(key).cast("string").alias("id"), F.col(key).cast("string").alias("document_id"), F.lit(currency).alias("currency"))
    found = Cat.with_results(_documents(spark, sf_dir).select("id"), of("customer", "c_custkey", 1, "EUR"), of("supplier", "s_suppkey", 0, "USD"))
    return found.select("id", "statement_id", "invoice_id", "currency")


@query("page_count", f"WITH d AS ({_DOCS}), p AS (SELECT * FROM (VALUES (0), (80), (1000000)) AS p(skip)), n AS (SELECT count(*) AS n FROM d WHERE NOT gone) SELECT skip::BIGINT AS skipped, greatest(0, least(100, n - skip))::BIGINT AS count FROM p, n")
def _(spark, sf_dir):
    live = _documents(spark, sf_dir).where("not is_deleted")
    counts = [Cat.page_count(live, 100, skip).select(F.lit(skip).cast("long").alias("skipped"), "count") for skip in (0, 80, 1_000_000)]
    return counts[0].union(counts[1]).union(counts[2])


@query("pdf_checks", """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'PDF_CORRUPTED' WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 'PDF_PASSWORD_REQUIRED'
  WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'PDF_WRONG_PASSWORD' WHEN p_size::INT * 5 > 200 THEN 'PDF_TOO_MANY_PAGES' END AS error_code,
  CASE WHEN p_partkey % 3 = 0 THEN (['V=0', 'RC4-40', 'RC4-128', 'V=3', 'AES-128', 'AES-256'])[p_partkey % 6 + 1] END AS encryption,
  p_partkey % 11 <> 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 1 AND p_partkey % 7 = 0 AS password_used FROM part""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    answers = L.table(spark, sf_dir, "part").select(
        key, key.cast("string").alias("file_id"), (key % 11 != 0).alias("opened"), F.when(key % 3 == 0, (key % 6).cast("int")).alias("encryption"), (key % 5 == 0).alias("empty_fits"),
        (key % 2 == 1).alias("password_given"), (key % 7 == 0).alias("password_fits"), (F.col("p_size").cast("int") * 5).alias("page_count"),
    )
    return V.check_pdfs(answers).select("p_partkey", "error_code", F.col("pdf_encryption_type").alias("encryption"), F.col("pdf_password_used").alias("password_used"))


@query("json_arrays", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN NULL ELSE replace(p_name, ' ', '|') END AS words, p_partkey % 4 IN (0, 2) AS missing FROM part")
def _(spark, sf_dir):
    key = F.col("p_partkey") % 4
    words = F.split("p_name", " ")
    stored = F.when(key == 1, "[broken").when(key == 2, "null").when(key == 3, to_json_array(words))
    back = from_json_array(stored)
    return L.table(spark, sf_dir, "part").select("p_partkey", F.array_join(back, "|").alias("words"), back.isNull().alias("missing"))


# --- the catalog: ingest, reprocessing, deletion

def _catalog(spark: SparkSession, sf_dir: str) -> tuple[Cat.Catalog, DataFrame]:
    """An empty catalog, and the statement files as raw bytes."""
    texts = L.statement_files(spark, sf_dir)
    files = texts.select("file_id", F.concat("file_id", F.lit(".csv")).alias("original_name"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"), F.lit("2026-01-01").cast("timestamp").alias("uploaded_at"))
    return Cat.Catalog(spark, Files.shared_folder(spark, "catalog")), Files.staged(files, "files")


@query("catalog_ingest", _LEDGER_SQL + "SELECT o_custkey::VARCHAR AS file_id, CASE WHEN count(*) FILTER (WHERE day(day) <= 12 AND day(day) <> month(day)) > 0 THEN 'partial' ELSE 'completed' END AS status, count(*) AS n_transactions, sum(amount)::DECIMAL(18,4) AS amount FROM l GROUP BY o_custkey")
def _(spark, sf_dir):
    catalog, files = _catalog(spark, sf_dir)
    taken = catalog.ingest(files, "first", "2026-01-02")
    statements = Cat.with_parent(catalog.raw("bank_transactions").select("bank_statement_id", "amount"), catalog.raw("bank_statements").select("id", "document_id"), "bank_statement_id")
    sums = statements.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_transactions"), _dec(F.sum("amount")).alias("amount"))
    return taken.where("error_code is null").join(sums, "document_id").select("file_id", "status", "n_transactions", "amount")


@query("catalog_reprocess", "SELECT o_custkey::VARCHAR || '.csv' AS original_name, 2::BIGINT AS n_jobs, TRUE AS reprocessed, 1::BIGINT AS n_duplicates FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    catalog, files = _catalog(spark, sf_dir)
    catalog.ingest(files, "first", "2026-01-02")
    refused = catalog.ingest(files, "second", "2026-01-03").where("error_code = 'DUPLICATE_FILE'").groupBy("original_name").agg(F.count(F.lit(1)).alias("n_duplicates"))
    catalog.ingest(files, "third", "2026-01-04", allow_reprocess=True)
    jobs = catalog.raw("processing_jobs")
    latest = Cat.latest_jobs(jobs).select("document_id", F.col("is_reprocess").alias("reprocessed"))
    counted = jobs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_jobs")).join(latest, "document_id")
    documents = catalog.table("documents").select(F.col("id").alias("document_id"), "original_name")
    return documents.join(counted, "document_id").join(refused, "original_name").select("original_name", "n_jobs", "reprocessed", "n_duplicates")


@query("catalog_soft_delete", "SELECT o_custkey::VARCHAR || '.csv' AS original_name, o_custkey % 4 = 0 AS taken_again FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey % 4 = 0 GROUP BY o_custkey")
def _(spark, sf_dir):
    catalog, files = _catalog(spark, sf_dir)
    catalog.ingest(files, "first", "2026-01-02")
    name = F.split_part("original_name", F.lit("."), F.lit(1)).cast("long")
    catalog.soft_delete_all(catalog.table("documents").where((name % 3 == 0) | (name % 4 == 0)), "2026-01-03", "gone")
    catalog.ingest(files.where(name % 4 == 0), "second", "2026-01-04")
    live = catalog.table("documents").where("not is_deleted")
    return live.select("original_name", F.contains("storage_path", F.lit("batch=second")).alias("taken_again"))


# --- files of equal bytes, encodings, job states, pages, purge

_TWINS = "WITH f AS (SELECT p_partkey, p_partkey // 5 AS g, p_partkey % 4 AS k FROM part)"


@query("duplicates_of_accepted", _TWINS + """, d AS (SELECT *, min(p_partkey) FILTER (WHERE k = 0) OVER (PARTITION BY g) AS first FROM f)
  SELECT p_partkey, CASE WHEN k = 2 THEN 'INVALID_EXTENSION' WHEN first < p_partkey THEN 'DUPLICATE_FILE' WHEN k <> 0 THEN 'FILE_TYPE_MISMATCH' ELSE 'ok' END AS code FROM d""")
def _(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.concat(key.cast("string"), F.element_at(F.array(*map(F.lit, (".csv", ".pdf", ".txt", ".xlsx"))), (key % 4 + 1).cast("int")))
    content = F.encode(F.concat(F.lit("Date,Amount\n"), F.floor(key / 5).cast("string")), "UTF-8")
    files = L.table(spark, sf_dir, "part").select(F.lpad(key.cast("string"), 12, "0").alias("file_id"), name.alias("original_name"), F.octet_length(content).cast("long").alias("length"), content.alias("content"), F.lit("2026-01-01").cast("timestamp").alias("uploaded_at"))
    return V.validate(files).select(F.col("file_id").cast("long").alias("p_partkey"), F.coalesce("error_code", F.lit("ok")).alias("code"))


@query("encoding_guess", r"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, text, regexp_replace(text, '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g') AS latin FROM documents)
  SELECT doc_id, CASE k WHEN 0 THEN 'utf-16-le' WHEN 1 THEN 'utf-16-be' WHEN 2 THEN 'windows-1252' WHEN 3 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  sha256(CASE WHEN k = 2 THEN '€ é ' || latin WHEN k = 3 THEN 'é ' || latin WHEN k = 4 THEN 'é ' || text ELSE text END) AS text_sha256 FROM d""")
def _(spark, sf_dir):
    kind, text = F.col("doc_id") % 5, F.col("text")
    latin = F.encode(F.regexp_replace(text, r"[^\x00-\x7F\xA0-\xFF]", "?"), "ISO-8859-1")
    content = (
        F.when(kind == 0, F.encode(text, "UTF-16LE")).when(kind == 1, F.encode(text, "UTF-16BE")).when(kind == 2, F.concat(F.unhex(F.lit("8020E920")), latin))
        .when(kind == 3, F.concat(F.unhex(F.lit("E920")), latin)).otherwise(F.encode(F.concat(F.lit("é "), text), "UTF-8"))
    )
    found = L.table(spark, sf_dir, "documents").select("doc_id", Files.decoded(content).alias("x"))
    return found.select("doc_id", "x.encoding", F.sha2("x.text", 256).alias("text_sha256"))


@query("encoding_euro_amount", "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) AS value FROM orders")
def _(spark, sf_dir):
    content = F.concat(F.unhex(F.lit("8020")), F.encode(L.thousands(L.money("o_totalprice")), "UTF-8"))
    texts = L.table(spark, sf_dir, "orders").select("o_orderkey", Files.decoded(content)["text"].alias("text"))
    return with_steps(texts, {"p": amount_steps(F.col("text"))}).select("o_orderkey", _dec(F.col("p.value")).alias("value"))


@query("date_added_forms", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def _(spark, sf_dir):
    forms = [F.date_format(_DAY, p) for p in ("EEEE, d MMMM yyyy", "EEE dd/MM/yyyy", "dd/MM/yyyy h:mm a", "d MMM yyyy HH:mm:ss")]
    texts = L.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))
    return with_steps(texts, {"p": date_steps(F.col("text"))}).select("o_orderkey", F.col("p.value").alias("day"))


@query("job_states", _LEDGER_SQL + """, d AS (SELECT o_custkey, count(*) FILTER (WHERE day(day) <= 12 AND day(day) <> month(day)) > 0 AS warned FROM l GROUP BY o_custkey)
  SELECT o_custkey::VARCHAR || '.csv' AS original_name, 'pending:1,processing:1,failed:1,processing:2,failed:2,processing:3,' || CASE WHEN warned THEN 'partial' ELSE 'completed' END || ':3' AS states,
  CASE WHEN warned THEN 'partial' ELSE 'completed' END AS state, 3::BIGINT AS attempt, 2::BIGINT AS retry_count FROM d""")
def _(spark, sf_dir):
    class Failing(Cat.Catalog):
        """The first two attempts break off."""

        tries = 0

        def _statements(self, *args):
            self.tries += 1
            if self.tries <= 2:
                raise RuntimeError("out of order")
            return super()._statements(*args)

    catalog, files = _catalog(spark, sf_dir)
    catalog = Failing(spark, catalog.root)
    catalog.ingest(files, "first", "2026-01-02", max_retries=3)
    rank = F.array_position(F.array(*map(F.lit, Cat.STATES)), F.col("state"))
    events = F.transform(F.array_sort(F.collect_list(F.struct("attempt", rank.alias("rank"), "state"))), lambda x: F.concat(x["state"], F.lit(":"), x["attempt"].cast("string")))
    told = catalog.raw("job_events").groupBy("job_id").agg(F.array_join(events, ",").alias("states"))
    jobs = catalog.raw("processing_jobs").select(F.col("id").alias("job_id"), F.col("retry_count").cast("long").alias("retry_count"))
    documents = catalog.table("documents").select(F.col("id").alias("document_id"), "original_name")
    found = told.join(catalog.job_states(), "job_id").join(jobs, "job_id").join(documents, "document_id")
    return found.select("original_name", "states", "state", F.col("attempt").cast("long").alias("attempt"), "retry_count")


@query("documents_walk", "SELECT id, (row_number() OVER (ORDER BY uploaded DESC, id) - 1) // 100 AS page FROM (SELECT s_suppkey::VARCHAR AS id, s_suppkey % 7 AS uploaded FROM supplier)")
def _(spark, sf_dir):
    documents = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.timestamp_seconds(F.col("s_suppkey") % 7).alias("uploaded_at"))
    return Cat.walk(documents, 100).select("id", "page")


@query("catalog_purge", "SELECT o_custkey::VARCHAR || '.csv' AS original_name, count(*) AS n_transactions, 0::BIGINT AS left_in_files FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey")
def _(spark, sf_dir):
    catalog, files = _catalog(spark, sf_dir)
    number = F.split_part("original_name", F.lit("."), F.lit(1)).cast("long")
    catalog.ingest(files.where(number % 2 == 0), "even", "2026-01-02")
    catalog.ingest(files.where(number % 2 == 1), "odd", "2026-01-03")
    doomed = Files.staged(catalog.table("documents").where(number % 3 == 0).select("id"), "doomed")
    catalog.purge(doomed)
    left = spark.read.parquet(f"{catalog.root}/documents").join(doomed, "id", "left_semi").agg(F.count(F.lit(1)).alias("left_in_files"))
    statements = catalog.raw("bank_statements").select(F.col("id").alias("bank_statement_id"), "document_id")
    counts = catalog.raw("bank_transactions").join(statements, "bank_statement_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_transactions"))
    documents = catalog.table("documents").select(F.col("id").alias("document_id"), "original_name")
    return documents.join(counts, "document_id").crossJoin(left).select("original_name", "n_transactions", "left_in_files")  # left is one row


# --- SQL text alone

@query("sql_functions", """SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) AS total, CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'D' END AS direction, o_orderstatus = 'P' AS warned,
  CASE WHEN o_orderkey % 2 = 0 THEN 'fee' ELSE CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END END AS kind, count(l_orderkey) AS n_lines, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,4) AS lines_sum
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(spark, sf_dir):
    Sql.register(spark)
    return spark.sql("""
      WITH texts AS (SELECT o_orderkey, date_format(o_orderdate, 'dd-MMM-yyyy') AS day, o_orderstatus AS status, format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS price FROM parquet.`{orders}`),
      o AS (SELECT o_orderkey, ledger_date(day).value AS day, ledger_split(if(status <> 'F', price, NULL), CASE status WHEN 'F' THEN price WHEN 'P' THEN '1.00' ELSE '-' END) AS paid,
        ledger_description(if(o_orderkey % 2 = 0, concat('Late\t', 'charge '), 'coffee')) AS description FROM texts),
      prices AS (SELECT l_orderkey, ledger_amount(concat('$', format_number(CAST(l_extendedprice AS DECIMAL(18,2)), 2), ' cr')) AS price FROM parquet.`{lines}`),
      l AS (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(price.value AS DECIMAL(18,4))) AS lines_sum FROM prices WHERE price.direction = 'C' GROUP BY l_orderkey)
      SELECT o_orderkey, day, CAST(paid.value AS DECIMAL(18,4)) AS total, paid.direction, paid.warning IS NOT NULL AS warned, ledger_type('', description, paid.direction) AS kind,
        coalesce(n_lines, 0) AS n_lines, CAST(lines_sum AS DECIMAL(18,4)) AS lines_sum
      FROM o LEFT JOIN l ON l_orderkey = o_orderkey""".format(orders=f"{sf_dir}/orders.parquet", lines=f"{sf_dir}/lineitem.parquet"))


@query("sql_tokeniser", """SELECT o_custkey, (2 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS line, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) AS amount,
  'Order ' || o_orderkey || '; ref' AS description, CASE WHEN o_custkey % 2 = 0 THEN ';' ELSE '|' END AS delimiter, 'GENERIC_SINGLE' AS format FROM orders""")
def _(spark, sf_dir):
    Sql.register(spark)
    return spark.sql("""
      WITH marked AS (SELECT o_custkey, o_orderkey, if(o_custkey % 2 = 0, ';', '|') AS mark, date_format(o_orderdate, 'MM/dd/yyyy') AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price FROM parquet.`{orders}`),
      texts AS (SELECT o_custkey, concat(concat_ws(first(mark), 'Date', 'Description', 'Amount'), '\n', array_join(transform(array_sort(collect_list(struct(o_orderkey, concat_ws(mark, day, concat('"Order ', o_orderkey, '; ref"'), price) AS line))), x -> x.line), '\n\n'), '\n') AS text
        FROM marked GROUP BY o_custkey),
      cells AS (SELECT o_custkey, line_no, cells, delimiter FROM texts, LATERAL ledger_records(text)),
      parsed AS (SELECT o_custkey, line_no, delimiter, cells[1] AS description, ledger_date_mdy(cells[0]) AS day, ledger_balance(cells[2]) AS amount FROM cells WHERE line_no > 1)
      SELECT o_custkey, CAST(line_no AS BIGINT) AS line, day.value AS day, CAST(amount AS DECIMAL(18,4)) AS amount, description, delimiter, ledger_bank_format(array(' Description', 'AMOUNT')) AS format
      FROM parsed""".format(orders=f"{sf_dir}/orders.parquet"))


# --- rows without amount or date, dates without year or day, error codes of files

_MESSY_SQL = """WITH m AS (SELECT o_custkey::VARCHAR AS file_id, (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS row_index, o_orderkey % 7 = 0 AS undated, o_orderkey % 5 = 0 AS blank, o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0 AS broken,
  o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END AS currency, CASE WHEN o_orderkey % 3 = 0 THEN 'R' || o_orderkey END AS reference FROM orders) """


def _messy(spark: SparkSession, sf_dir: str) -> S.Statements:
    """A statement per customer, with rows that lack a date, an amount, a currency or a reference."""
    key = F.col("o_orderkey")
    day = F.when(key % 7 == 0, "pending").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    amount = F.when(key % 5 == 0, " n/a ").when(key % 11 == 0, "1.2.3").otherwise(F.concat(L.plain(L.money("o_totalprice")), F.lit(" CR")))
    line = F.concat_ws("|", day, F.concat(F.lit("Order "), key.cast("string")), amount, F.when(key % 2 == 0, " eur ").otherwise(" "), F.when(key % 3 == 0, F.concat(F.lit(" R"), key.cast("string"))).otherwise("  "))
    lines = L.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("file_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    text = F.concat(F.lit(" Date |Description|Amount|Currency|Reference\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    files = lines.select("file_id", text.alias("text"), F.lit("ascii").alias("encoding"))
    return S.parse(Files.staged(Files.tokenise(files), "grid"), files.select("file_id", "encoding"), stage=lambda rows: Files.staged(rows, "rows"))


@query("missing_amounts", _MESSY_SQL + """SELECT file_id, row_index, CASE WHEN blank OR broken THEN 0 ELSE price END::DECIMAL(18,4) AS amount, CASE WHEN blank OR broken THEN 'D' ELSE 'C' END AS direction, currency, reference,
  CASE WHEN blank THEN 1 WHEN broken THEN 2 ELSE 0 END::BIGINT AS n_warnings FROM m WHERE NOT undated""")
def _(spark, sf_dir):
    found = _messy(spark, sf_dir).transactions
    return found.select("file_id", F.col("row_index").cast("long").alias("row_index"), "amount", "direction", "currency", F.col("reference_number").alias("reference"), F.size("parse_warnings").cast("long").alias("n_warnings"))


@query("undated_rows", _MESSY_SQL + """SELECT file_id, count(*) FILTER (WHERE NOT undated) AS n_parsed, 0::BIGINT AS n_skipped, count(*) FILTER (WHERE undated) AS n_dropped, CASE WHEN count(*) FILTER (WHERE NOT undated) = 0 THEN 'CSV_NO_DATA_ROWS' END AS error_code,
  '0=Date,1=Description,2=Amount,3=Currency,4=Reference' AS headers FROM m GROUP BY 1""")
def _(spark, sf_dir):
    headers = F.array_join(F.transform(F.sort_array(F.map_entries("raw_headers")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")
    count = lambda c, n: F.col(c).cast("long").alias(n)
    return _messy(spark, sf_dir).statements.select("file_id", count("total_rows_parsed", "n_parsed"), count("total_rows_skipped", "n_skipped"), count("total_rows_dropped", "n_dropped"), "error_code", headers.alias("headers"))


@query("date_missing_parts", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN date_trunc('month', o_orderdate)::DATE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL
  ELSE make_date({config.DATE_RULES.default.year}, month(o_orderdate), day(o_orderdate)) END AS day FROM orders""")
def _(spark, sf_dir):
    forms = F.array(F.date_format(_DAY, "MMMM d"), F.date_format(_DAY, "d MMM"), F.date_format(_DAY, "MMM yyyy"))
    texts = L.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("text"))
    rules = config.DateRules(default=config.DATE_RULES.default.replace(day=1))
    return with_steps(texts, {"p": date_steps(F.col("text"), rules=rules)}).select("o_orderkey", F.col("p.value").alias("day"))


@query("error_codes_met", """WITH f AS (SELECT *, octet_length(encode(text)) AS n, doc_id % 4 AS k FROM documents), g AS (SELECT *, min(doc_id) FILTER (WHERE k = 0 AND n >= 10) OVER (PARTITION BY text) AS first FROM f),
  c AS (SELECT CASE WHEN k = 2 THEN 'INVALID_EXTENSION' WHEN n = 0 THEN 'EMPTY_FILE' WHEN first < doc_id THEN 'DUPLICATE_FILE' WHEN k <> 0 THEN 'FILE_TYPE_MISMATCH' WHEN n < 10 THEN 'CSV_PARSE_ERROR' END AS code FROM g)
  SELECT t.code, t.http_status, t.stage, count(c.code) AS n_files FROM (VALUES """ + ", ".join(f"('{c}', {s}, '{g}')" for c, s, g in ERROR_CODES) + ") AS t(code, http_status, stage) LEFT JOIN c ON c.code = t.code GROUP BY ALL")
def _(spark, sf_dir):
    padded = _doc_files(spark, sf_dir).withColumn("content", F.concat(F.unhex(F.lit("EFBBBF")), F.col("content")))  # a mark makes any text text
    codes = spark.createDataFrame(list(ERROR_CODES), "code string, http_status int, stage string")
    met = V.validate(padded).groupBy(F.col("error_code").alias("code")).agg(F.count(F.lit(1)).alias("n_files"))
    return codes.join(met, "code", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


# --- the catalog's answers, and the stream

_TAKEN = _LEDGER_SQL + ", s AS (SELECT o_custkey AS k, CASE WHEN count(*) FILTER (WHERE day(day) <= 12 AND day(day) <> month(day)) > 0 THEN 'partial' ELSE 'completed' END AS status FROM l GROUP BY o_custkey) "


@query("catalog_list", _TAKEN + """SELECT 'partial' AS asked, least(100, count(*)) AS n FROM s WHERE status = 'partial' UNION ALL SELECT 'completed', least(100, count(*)) FROM s WHERE status = 'completed'
  UNION ALL SELECT 'invoice', 0 UNION ALL SELECT 'later', least(100, count(*)) FROM s WHERE k % 2 = 1 UNION ALL SELECT 'earlier and partial', least(100, count(*)) FROM s WHERE k % 2 = 0 AND status = 'partial' UNION ALL SELECT 'in EUR', 0""")
def _(spark, sf_dir):
    catalog, files = _catalog(spark, sf_dir)
    odd = F.col("file_id").cast("long") % 2 == 1
    catalog.ingest(files.where(~odd), "even", "2026-01-02")
    catalog.ingest(files.where(odd), "odd", "2026-01-04")
    asked = {
        "partial": {"status": "partial"}, "completed": {"status": "completed"}, "invoice": {"document_type": "invoice"}, "later": {"uploaded_after": "2026-01-03"},
        "earlier and partial": {"uploaded_before": "2026-01-03", "status": "partial", "document_type": "bank_statement"}, "in EUR": {"currency": "EUR"},
    }
    found = [catalog.list_documents(limit=100, **how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "n") for name, how in asked.items()]
    return reduce(DataFrame.unionByName, found)


@query("catalog_lookup", _TAKEN + "SELECT k::VARCHAR || '.csv' AS original_name, status, 'third' AS batch, TRUE AS reprocessed, TRUE AS same_bytes FROM s WHERE k = (SELECT min(k) FROM s)")
def _(spark, sf_dir):
    catalog, files = _catalog(spark, sf_dir)
    for batch, at in (("first", "2026-01-02"), ("third", "2026-01-04")):
        taken = catalog.ingest(files, batch, at, allow_reprocess=True)
    wanted = taken.orderBy(F.col("file_id").cast("long")).limit(1).first()["document_id"]
    document, job = catalog.get_document(wanted), catalog.latest_job(wanted)
    content = catalog.content(wanted).select(V.checksum(F.col("content")).alias("_checksum"))
    batch = F.when(F.col("started_at") == F.lit("2026-01-04").cast("timestamp"), "third").otherwise("first").alias("batch")
    told = Cat.with_jobs(document, job.select("document_id", "status", batch, F.col("is_reprocess").alias("reprocessed")))
    held = told.join(content, F.col("checksum_sha256") == F.col("_checksum"), "left")
    return held.select("original_name", "status", "batch", "reprocessed", F.col("_checksum").isNotNull().alias("same_bytes"))


@query("stream_ingest", "SELECT o_custkey::VARCHAR AS customer, count(*) AS n_transactions, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,4) AS amount FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """Orders as delimited files arrive in a folder, then the same files again: those are refused."""
    inbox, catalog = Files.shared_folder(spark, "inbox"), Cat.Catalog(spark, Files.shared_folder(spark, "catalog"))
    lines = L.table(spark, sf_dir, "orders").select(
        F.date_format(_DAY, "dd/MM/yyyy").alias("Date"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("Description"),
        F.concat(L.plain(L.money("o_totalprice")), F.lit(" CR")).alias("Amount"), F.col("o_custkey").cast("string").alias("Reference"), "o_orderkey",
    ).repartition(4, "o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey")
    for arrival in ("first", "second"):
        lines.write.option("header", True).option("maxRecordsPerFile", 50_000).csv(f"{inbox}/{arrival}")
        Stream.start(catalog, Stream.stream_files(spark, f"{inbox}/*", 3), f"{catalog.root}/_stream", name="inbox").awaitTermination()
    found = catalog.raw("bank_transactions").groupBy(F.col("reference_number").alias("customer"))
    return found.agg(F.count(F.lit(1)).alias("n_transactions"), _dec(F.sum("amount")).alias("amount"))
