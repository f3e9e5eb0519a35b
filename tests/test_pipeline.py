"""Files to tables: tokenising, statements, validation, catalog, streaming and invoices."""

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.config import Limits
from ledgermill.operators import invoices as I, quality, statements as S, validate as V
from ledgermill.plans.catalog import Catalog
from ledgermill.sources import files as Files
from ledgermill.streaming import ingest as stream

STANDARD = "Date,Description,Debit,Credit,Balance\n01/05/2026,Opening,,,1000.00\n02/05/2026,\"Shop, corner\",100.00,,900.00\n15/05/2026,Salary,,500.00,1400.00\n31/05/2026,NEFT out,50.00,,1300.00\n"
EUROPEAN = "Datum;Buchungstext;Betrag;Währung;Kontostand\n13.05.2026;Miete;-850,00;EUR;1.150,00\n14.05.2026;Übertrag;1.000,00 CR;EUR;2.150,00\n\n15.05.2026;Kaffee;3,50;USD;2.146,50\n"
PREAMBLE = "My Bank\nAccount 1\n\nDate,Narration,Chq./Ref.No.,Value Dt,Withdrawal Amt (Dr),Deposit Amt (Cr),Closing Balance\n13/05/26,ATM 1,77,13/05/26,\"1,000.00\",,\"9,000.00\"\n\n14/05/26,Salary,,14/05/26,,500.00,9500.00\nDate,Narration,Chq./Ref.No.,Value Dt,Withdrawal Amt (Dr),Deposit Amt (Cr),Closing Balance\nTotal,,,,1000,500,\nbad date,x,,,1,,2\n"


def parse(spark, *texts, limits=Limits()):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, text string").withColumn("encoding", F.lit("utf-8"))
    found = S.parse(Files.tokenise(files), files, limits)
    return found, {r["file_id"]: r for r in found.statements.collect()}


def test_standard(spark):
    found, by = parse(spark, STANDARD)
    s = by["f0"]
    assert (s["detected_delimiter"], s["detected_format"], s["total_rows_parsed"], s["total_rows_skipped"]) == (",", "GENERIC_SPLIT", 4, 0)
    assert (s["statement_from"], s["statement_to"], s["opening_balance"], s["closing_balance"]) == (dt.date(2026, 5, 1), dt.date(2026, 5, 31), Decimal(1000), Decimal(1300))
    assert [w["field"] for w in s["warnings"]] == ["balance_row_5", "row_2", "row_3"]
    assert s["warnings"][0]["message"] == "Balance discontinuity at row 5: expected ~1350.00, got 1300.00. Diff: 50.00. Possible missing rows."
    rows = found.transactions.orderBy("row_index").collect()
    assert [(r["row_index"], r["amount"], r["direction"], r["transaction_type"]) for r in rows] == [(2, 0, "D", "debit"), (3, 100, "D", "debit"), (4, 500, "C", "credit"), (5, 50, "D", "transfer")]
    assert rows[1]["description"] == "Shop, corner" and rows[0]["parse_warnings"][-1] == "amount: Missing or null — row retained without amount"


def test_european(spark):
    found, by = parse(spark, EUROPEAN)
    s = by["f0"]
    assert (s["detected_delimiter"], s["currency"], s["total_rows_parsed"], s["total_rows_skipped"]) == (";", "EUR", 3, 1)
    assert s["warnings"][0]["field"] == "currency"
    assert [(r["row_index"], r["amount"], r["direction"], r["balance_after"]) for r in found.transactions.orderBy("row_index").collect()] == [(2, 850, "D", 1150), (3, 1000, "C", 2150), (5, Decimal("3.5"), "D", Decimal("2146.5"))]


def test_preamble_and_fates(spark):
    found, by = parse(spark, PREAMBLE)
    s = by["f0"]
    assert (s["detected_format"], s["total_rows_parsed"], s["total_rows_skipped"], s["total_rows_dropped"]) == ("HDFC_STANDARD", 2, 3, 1)
    assert s["raw_headers"][6] == "Closing Balance"
    rows = found.transactions.orderBy("row_index").collect()
    assert [(r["row_index"], r["reference_number"], r["value_date"]) for r in rows] == [(5, "77", dt.date(2026, 5, 13)), (7, None, dt.date(2026, 5, 14))]
    fates = {r["skip_reason"] for r in found.rows.collect()}
    assert fates == {None, "blank_row", "repeated_header_row", "summary_row"}


def test_failures_and_limit(spark):
    rows = "Date,Description,Amount\n" + "".join(f"{13 + i % 15}/05/2026,x,{i + 1}\n" for i in range(20))
    _, by = parse(spark, "", "a,b\n1,2\n", "Date,Amount\n", rows, limits=Limits(max_csv_rows=5))
    assert [by[f"f{i}"]["error_code"] for i in range(4)] == ["CSV_PARSE_ERROR", "CSV_MISSING_REQUIRED_COLUMNS", "CSV_NO_DATA_ROWS", None]
    assert by["f1"]["missing"] == ["date", "amount (or debit/credit)"]
    assert by["f3"]["total_rows_parsed"] == 5 and by["f3"]["warnings"][0]["field"] == "row_count"


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_delimiters_and_ragged_records(spark, mark):
    text = mark.join(("Date", "Amount", "Balance")) + "\n" + mark.join(("13/05/2026", '"1\n2"', "5")) + "\n\n" + "13/05/2026\n" + mark.join(("14/05/2026", "7", "8", "9", "10")) + "\n"
    found, by = parse(spark, text)
    assert by["f0"]["detected_delimiter"] == mark
    assert [(r["row_index"], r["amount"]) for r in found.transactions.orderBy("row_index").collect()] == [(2, 0), (5, 7)]


def test_decoding(spark):
    cases = [b"\xef\xbb\xbfa,b", "ü,b".encode("utf-16"), b"a,b", "ü".encode(), "ü".encode("latin-1"), b""]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = [(r["x"]["text"], r["x"]["encoding"]) for r in df.select("i", Files.decoded(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [("a,b", "utf-8-sig"), ("ü,b", "utf-16"), ("a,b", "ascii"), ("ü", "utf-8"), ("ü", "latin-1"), ("", "ascii")]


def workbook(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r, 1) if v) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_validation(spark):
    files = [("a.csv", STANDARD.encode()), ("b.txt", b"x"), ("c.csv", b""), ("d.csv", b"%PDF-1.7 ......."), ("e.pdf", b"%PDF-1.7"), ("f.csv", STANDARD.encode()), ("g.csv", b"a,b\n"), ("h.xlsx", workbook([("Date", "Amount")])), ("i.csv", workbook([("a",)])), ("j.xlsx", b"PK\x03\x04zip"), ("k.csv", b"\x00\xff\x00" * 9)]
    df = spark.createDataFrame([(n, f"dir/{n}", len(c), bytearray(c), dt.datetime(2026, 1, 1)) for n, c in files], "file_id string, original_name string, length long, content binary, uploaded_at timestamp")
    got = {r["file_id"][0]: r["error_code"] for r in V.validate(df).collect()}
    assert got == {"a": None, "b": "INVALID_EXTENSION", "c": "EMPTY_FILE", "d": "FILE_TYPE_MISMATCH", "e": None, "f": "DUPLICATE_FILE", "g": "CSV_PARSE_ERROR", "h": None, "i": "FILE_TYPE_MISMATCH", "j": "UNSUPPORTED_FORMAT", "k": "UNSUPPORTED_FORMAT"}
    small = V.validate(df, limits=Limits(max_csv_bytes=20)).where("file_id = 'a.csv'").first()
    assert small["error_code"] == "FILE_TOO_LARGE"
    names = spark.createDataFrame([("../x y.csv",), ("",), ("a\\b.csv",), ("l" * 300 + ".csv",)], "n string")
    assert [r[0] for r in names.select(V.safe_name(F.col("n"))).collect()] == ["x_y.csv", "upload", "b.csv", "l" * 200 + ".csv"]


def test_size_limit_reaches_the_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 100)
    (tmp_path / "b.csv").write_bytes(b"a,b\n1,2\n3,4\n")
    found = Files.scan(spark, str(tmp_path), 50)
    assert "LessThanOrEqual(length,50)" in found._jdf.queryExecution().toString()
    assert {r["original_name"]: (r["length"], r["content"] is None) for r in found.collect()} == {"a.csv": (100, True), "b.csv": (12, False)}
    codes = {r["original_name"]: r["error_code"] for r in V.validate(found, limits=Limits(max_csv_bytes=50, min_csv_bytes=1)).collect()}
    assert codes == {"a.csv": "FILE_TOO_LARGE", "b.csv": None}


def test_active_sheet_and_dates(spark):
    """The second sheet is active; its date cells, in a built-in and in an own format, come out as dates."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="x1"/><sheet name="b" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet2.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {space}><numFmts><numFmt numFmtId="170" formatCode="dd\\/mm\\/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Date</t></is></c><c r="B1" t="inlineStr"><is><t>Amount</t></is></c></row>'
                   '<row r="2"><c r="A2" s="1"><v>46155</v></c><c r="B2" s="3"><v>46155</v></c></row><row r="3"><c r="A3" s="2"><v>46155.5</v></c><c r="B3"><v>7</v></c></row></sheetData></worksheet>')  # fmt: skip
    df = spark.createDataFrame([("f", bytearray(out.getvalue()))], "file_id string, content binary")
    assert Files.xlsx_text(df).first()["text"] == "Date,Amount\n2026-05-13 00:00:00,46155\n2026-05-13 12:00:00,7\n"


def test_a_batch_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "s.csv", STANDARD.encode())
    files, c = Files.scan(spark, str(tmp_path / "in")), Catalog(spark, str(tmp_path / "cat"))
    write = Catalog.append

    def broken(self, name, df, batch):
        if name == "processing_jobs":
            raise RuntimeError("stopped")
        write(self, name, df, batch)

    monkeypatch.setattr(Catalog, "append", broken)
    with pytest.raises(RuntimeError):
        c.ingest(files, "b1", dt.datetime(2026, 6, 1))
    assert all(c.table(t).count() == 0 for t in ("documents", "bank_statements", "bank_transactions", "processing_jobs"))
    monkeypatch.setattr(Catalog, "append", write)
    assert c.ingest(files, "b2", dt.datetime(2026, 6, 1)).first()["error_code"] is None  # nothing of b1 makes it a duplicate
    assert c.table("documents").count() == 1 and c.documents_with_results().first()["statement_id"] is not None


def test_extractor_answers(spark, tmp_path):
    names = ("ok", "locked", "wrong", "empty", "given", "torn", "long")
    for n in names:
        put(tmp_path / "in", f"{n}.pdf", b"%PDF-1.7 " + n.encode())
    files = Files.scan(spark, str(tmp_path / "in"))
    answers = {"ok": (True, None, None, None, None, 1), "locked": (True, 4, False, False, None, 1), "wrong": (True, 5, False, True, False, 1), "empty": (True, 1, True, None, None, 1), "given": (True, 2, False, True, True, 1), "torn": (False, None, None, None, None, None), "long": (True, None, None, None, None, 201)}
    said = spark.createDataFrame([(f"{k}.pdf", *v) for k, v in answers.items()], "original_name string, opened boolean, encryption int, empty_fits boolean, password_given boolean, password_fits boolean, page_count int")
    texts = files.select("file_id", "original_name").join(said, "original_name").drop("original_name").withColumns({"text": F.lit("Vendor: Acme\nTotal: 5\n"), "tables": F.expr(f"cast(array() as {I.TABLES})"), "page_texts": F.array(F.lit("x" * 60))})
    got = {r["original_name"].split(".")[0]: r["error_code"] for r in Catalog(spark, str(tmp_path / "cat")).ingest(files, "b", dt.datetime(2026, 6, 1), texts=texts).collect()}
    assert got == {"ok": None, "locked": "PDF_PASSWORD_REQUIRED", "wrong": "PDF_WRONG_PASSWORD", "empty": None, "given": None, "torn": "PDF_CORRUPTED", "long": "PDF_TOO_MANY_PAGES"}


def test_database_tables(spark, tmp_path):
    from ledgermill.sources import jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).selectExpr("id", "concat('n', id) as name")
    jdbc.write_table(rows, url, "vendors", mode="overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = jdbc.read_table(spark, url, "vendors", key="id", partitions=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100 and got.agg(F.sum("id")).first()[0] == 4950
    assert jdbc.read_table(spark, url, "vendors", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").where("id = 7").first()["name"] == "n7"


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)


def test_catalog_flow(spark, tmp_path):
    inbox, at = tmp_path / "in", dt.datetime(2026, 6, 1)
    put(inbox, "s.csv", STANDARD.encode())
    put(inbox, "w.xlsx", workbook([("Date", "Description", "Amount"), ("13/05/2026", "fee", "5.00")]))
    put(inbox, "bad.csv", b"just,some\nother,file\n")
    put(inbox, "i.pdf", b"%PDF-1.7 invoice")
    files = Files.scan(spark, str(inbox))
    pdf = files.where("original_name = 'i.pdf'").select("file_id", F.lit("Vendor: Acme\nInvoice No: A-1\nDate: 13/05/2026\nSubtotal: 20.00\nTotal: 20.00\n").alias("text"),
                                                        F.array(F.array(F.array(*map(F.lit, ("Item", "Qty", "Total"))), F.array(*map(F.lit, ("Nut", "2", "20.00"))))).alias("tables"), F.array(F.lit("x" * 60)).alias("page_texts"))
    c = Catalog(spark, str(tmp_path / "cat"))
    first = {r["original_name"]: r for r in c.ingest(files, "b1", at, texts=pdf).collect()}
    assert {k: (r["status"], r["error_code"]) for k, r in first.items()} == {"s.csv": ("partial", None), "w.xlsx": ("partial", None), "bad.csv": ("failed", "CSV_MISSING_REQUIRED_COLUMNS"), "i.pdf": ("completed", None)}
    again = {r["original_name"]: r["document_id"] for r in c.ingest(files, "b1", at, texts=pdf).collect()}
    assert again == {k: r["document_id"] for k, r in first.items()} and c.table("documents").count() == 4  # a replayed batch replaces itself
    assert {r["error_code"] for r in c.ingest(files, "b2", at).collect()} == {"DUPLICATE_FILE"}
    third = c.ingest(files.where("original_name = 's.csv'"), "b3", dt.datetime(2026, 6, 2), allow_reprocess=True).first()
    assert third["document_id"] == first["s.csv"]["document_id"] and c.table("documents").count() == 4
    job = c.latest_job(third["document_id"]).first()
    assert job["is_reprocess"] and job["created_at"] == dt.datetime(2026, 6, 2) and c.raw("bank_statements").count() == 3
    assert c.list_documents(document_type="invoice").count() == 1 and c.list_documents(status="failed").count() == 1 and c.list_documents(currency="USD").count() == 1
    assert c.list_documents(limit=2).count() == 2 and c.list_documents(limit=2, offset=3).count() == 1
    with pytest.raises(ValueError):
        c.list_documents(limit=101)
    assert bytes(c.content(third["document_id"]).first()["content"]) == STANDARD.encode() and c.content("none").count() == 0
    assert c.raw("processing_jobs").where("status = 'failed'").first()["error_detail"] == {"missing_columns": "date, amount (or debit/credit)"}
    assert c.invoice_with_lines().first()["line_items"][0]["unit_price"] == 10 and c.raw("vendors").first()["canonical_name"] == "Acme"
    assert [len(r["transactions"]) for r in c.statement_with_transactions().collect()].count(4) == 2
    c.soft_delete(third["document_id"], dt.datetime(2026, 6, 3))
    assert c.get_document(third["document_id"]).count() == 0 and c.list_documents().count() == 3
    fresh = c.ingest(files.where("original_name = 's.csv'"), "b4", at).first()
    assert fresh["error_code"] is None and fresh["document_id"] != third["document_id"]  # a deleted file may come again
    tables = {t: c.table(t) for t in ("documents", "processing_jobs", "bank_statements", "bank_transactions", "invoices", "invoice_line_items", "vendors")}
    bad = quality.violations(tables).where("violations > 0").collect()
    assert [(r["table_name"], r["constraint_name"]) for r in bad] == [("documents", "unique_checksum_sha256")]  # the deleted one and the fresh one


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "a.csv", STANDARD.encode())
    put(inbox, "b.csv", STANDARD.encode())
    c = Catalog(spark, str(tmp_path / "cat"))
    run = lambda: stream.start(c, stream.stream_files(spark, str(inbox)), str(tmp_path / "cp")).awaitTermination()
    run()
    assert c.table("documents").count() == 1 and c.raw("bank_transactions").count() == 4
    put(inbox, "c.csv", STANDARD.encode())
    put(inbox, "d.csv", EUROPEAN.encode())
    run()
    assert c.table("documents").count() == 2 and c.raw("bank_statements").count() == 2


HEAD = ["Description", "Qty", "Unit Price", "Total"]


def invoice(spark, text, tables=(), **options):
    docs = spark.createDataFrame([("f", text, [list(map(list, t)) for t in tables])], f"file_id string, text string, tables {I.TABLES}")
    found, lines = I.parse(docs, **options)
    return found.first(), lines.orderBy("line_number").collect()


def test_invoice_full(spark):
    text = "From: Acme Ltd\nInvoice No: INV-2026-1\nInvoice Date: 29/05/2026\nDue Date: 28/06/2026\nSubtotal: $1,500.00\nTax: $120.00\nTotal: $1,620.00\n"
    got, lines = invoice(spark, text, [[HEAD, ["Work", "10", "100.00", "1,000.00"], ["Parts", "5", "100.00", ""], [None, None, None, None], ["Subtotal", "", "", "1500"]]])
    assert (got["raw_vendor_name"], got["invoice_number"], got["invoice_date"], got["due_date"], got["currency"]) == ("Acme Ltd", "INV-2026-1", dt.date(2026, 5, 29), dt.date(2026, 6, 28), "USD")
    assert (got["subtotal"], got["tax_amount"], got["total_amount"], got["confidence"], got["warnings"]) == (1500, 120, 1620, 1, [])
    assert [(r["description"], r["quantity"], r["unit_price"], r["line_total"]) for r in lines] == [("Work", 10, 100, 1000), ("Parts", 5, 100, 500)]


def test_invoice_mismatch_and_quirks(spark):
    got, _ = invoice(spark, "Vendor: V Co\nInvoice No: 1\nDate: 29/05/2026\nSubtotal: 1000.00\nTax: 80.00\nTotal: 1080.00\n", [[HEAD, ["a", "1", "150", "150"]]])
    assert len(got["warnings"]) == 1 and "differs from Subtotal" in got["warnings"][0]
    got, _ = invoice(spark, "Acme\nInvoice\n")
    assert (got["invoice_number"], got["currency"], got["raw_vendor_name"], got["confidence"]) == ("oice", "USD", "Acme", Decimal("0.700"))
    got, _ = invoice(spark, "Due Date: 28/06/2026\nDate: 01/01/2026\nSub-total: 5.00\nTax ID: 123\n")
    assert (got["invoice_date"], got["total_amount"]) == (dt.date(2026, 6, 28), 5)
    assert invoice(spark, None)[0]["confidence"] == Decimal("0.400")


def test_invoice_text_lines_and_strictness(spark):
    text = "Acme Company\nDescription Qty Price Total\nBolt 2 $1.50 $3.00\nodd line\nWasher big 10 0.10 1.00\nTotal 4.00\nNut 1 1 1\n"
    _, lines = invoice(spark, text)
    assert [(r["description"], r["quantity"], r["line_total"]) for r in lines] == [("Bolt", 2, 3), ("Washer big", 10, 1)]
    table = [[["x"]], [HEAD, ["a", "many", "1", "2"], ["b", "2"]]]
    got, lines = invoice(spark, "Acme", table)
    assert [(r["quantity"], r["bad_fields"]) for r in lines] == [(None, ["quantity"]), (2, [])] and got["error_code"] is None
    assert invoice(spark, "Acme", table, strict=True)[0]["error_code"] == "PARTIAL_PARSE"


def test_cascade_and_ddl(spark):
    from ledgermill import schemas

    tables = {
        "documents": spark.createDataFrame([("d1",), ("d2",)], "id string"), "processing_jobs": spark.createDataFrame([("j1", "d1"), ("j2", "d2")], "id string, document_id string"),
        "bank_statements": spark.createDataFrame([("s1", "d1", "j1"), ("s2", "d2", "j2")], "id string, document_id string, processing_job_id string"), "bank_transactions": spark.createDataFrame([("t1", "s1"), ("t2", "s2")], "id string, bank_statement_id string"),
    }
    kept = quality.cascade(tables, spark.createDataFrame([("d1",)], "id string"))
    assert {t: [r["id"] for r in df.collect()] for t, df in kept.items()} == {"documents": ["d2"], "processing_jobs": ["j2"], "bank_statements": ["s2"], "bank_transactions": ["t2"]}
    schemas.create_tables(spark, "ledger_test")
    schemas.create_tables(spark, "ledger_test")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN ledger_test").collect()} == set(schemas.TABLES)
    assert spark.table("ledger_test.invoices").schema["confidence"].dataType.simpleString() == "decimal(4,3)"
    schemas.drop_tables(spark, "ledger_test")
    assert spark.sql("SHOW TABLES IN ledger_test").count() == 0
