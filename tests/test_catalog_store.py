"""How the catalog keeps its tables: contents out of exchanges, folding, purge, vendors of two writers, retries, the stream's cap."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgermill.config import Limits
from ledgermill.operators import validate as V
from ledgermill.plans.catalog import Catalog
from ledgermill.plans.manifest import Entry, Manifest
from ledgermill.sources import files as Files
from ledgermill.streaming import ingest as stream

STATEMENT = b"Date,Description,Amount\n13/05/2026,fee,5.00\n"
AT = dt.datetime(2026, 6, 1)
FILES = "file_id string, original_name string, length long, content binary, uploaded_at timestamp"


def frame(spark, *files):
    return spark.createDataFrame([(n, n, len(c), bytearray(c), AT) for n, c in files], FILES)


def test_twins_of_refused_files_are_taken_and_contents_stay(spark):
    df = frame(spark, ("a.txt", STATEMENT), ("b.pdf", STATEMENT), ("c.csv", STATEMENT), ("d.csv", STATEMENT), ("e.pdf", STATEMENT))
    found = V.validate(df)
    assert {r["file_id"]: r["error_code"] for r in found.collect()} == {"a.txt": "INVALID_EXTENSION", "b.pdf": "FILE_TYPE_MISMATCH", "c.csv": None, "d.csv": "DUPLICATE_FILE", "e.pdf": "DUPLICATE_FILE"}
    df.write.mode("overwrite").parquet(path := Files.shared_folder(spark, "twins"))
    plan = V.validate(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Window" in x or "Sort" in x or "Join" in x]
    assert moved and not any("content#" in x for x in moved)
    assert "content" not in V.validate(spark.read.parquet(path)).columns
    refused = spark.createDataFrame([("p.pdf", False)], "file_id string, opened boolean")
    for c, kind in (("encryption", "int"), ("empty_fits", "boolean"), ("password_given", "boolean"), ("password_fits", "boolean"), ("page_count", "int")):
        refused = refused.withColumn(c, F.lit(None).cast(kind))
    assert V.validate(frame(spark, ("p.pdf", b"%PDF-1.7 x")), extracted=refused).first()["error_code"] == "PDF_CORRUPTED"


def test_manifest(spark, tmp_path):
    one, two = Manifest(spark, str(tmp_path)), Manifest(spark, str(tmp_path))
    one.add(Entry(("a",), {"t": ["a"]}))
    two.add(Entry(("b",), {"t": ["b"]}))
    one.add(Entry(("a",), {"t": ["a"]}))  # a batch that is written again takes its own place
    assert sorted(b for e in one.read()[1] for b in e.batches) == ["a", "b"]
    version = one.read()[0]
    (tmp_path / "_manifest" / f"v{version + 1:012d}").write_bytes(b'[{"batches": ["c"')  # a writer that broke off
    assert len(two.read()[1]) == 2
    two.hide(lambda b: b == "b")
    assert [e.batches for e in one.read()[1]] == [("a",)]
    assert not one.exchange((Entry(("x",), {}),), ())
    for i in range(20):
        one.add(Entry((f"n{i}",), {"t": [f"n{i}"]}))
    assert len(os.listdir(tmp_path / "_manifest")) < 40  # with checksum files


def test_folding_keeps_entries_few(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    row = lambda i: spark.createDataFrame([(f"d{i}", AT)], "document_id string, deleted_at timestamp")
    fold = c.fold
    c.fold = lambda fan=3: fold(3)
    for i in range(14):
        c.append("deletions", row(i), f"b{i}")
        c.commit(f"b{i}")
    entries = c.manifest.read()[1]
    assert len(entries) <= 6 and max(e.level for e in entries) == 2
    assert {r["document_id"] for r in c.raw("deletions").collect()} == {f"d{i}" for i in range(14)} and len(c.batches()) == 14
    assert sum(m["deletions"]["rows"] for m in c.metrics().values()) == 14
    c.append("deletions", row(99), "b1")  # a batch inside a folded folder is written again
    c.commit("b1")
    assert {r["document_id"] for r in c.raw("deletions").collect()} == {f"d{i}" for i in range(14) if i != 1} | {"d99"}
    assert c.raw("deletions", but="b2").count() == 13
    before = c.raw("deletions").count()
    assert c.vacuum() > 0 and c.raw("deletions").count() == before


def test_vendors_of_two_batches(spark, tmp_path):
    """Two batches that ran at the same time each added the vendor: one row, both spellings."""
    c = Catalog(spark, str(tmp_path / "cat"))
    for batch, name, at in (("one", "ACME", 1), ("two", "Acme", 2)):
        made = spark.createDataFrame([("v", name, [name], dt.datetime(2026, 1, at))], "id string, canonical_name string, raw_names array<string>, created_at timestamp")
        c.append("vendors", made.withColumn("updated_at", F.col("created_at")), batch)
        c.commit(batch)
    rows = c.table("vendors").collect()
    assert [(r["canonical_name"], r["raw_names"]) for r in rows] == [("ACME", ["ACME", "Acme"])] and c.raw("vendors").count() == 2


def test_an_attempt_that_fails_for_good(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "cat"))

    def broken(*args):
        raise RuntimeError("no store")

    with monkeypatch.context() as m:
        m.setattr(c, "_statements", broken)
        with pytest.raises(RuntimeError):
            c.ingest(frame(spark, ("a.csv", STATEMENT)), "b", AT, max_retries=1)
    state = c.job_states().first()
    assert (state["state"], state["attempt"], state["message"]) == ("failed", 2, "no store") and c.table("documents").count() == 0
    assert c.ingest(frame(spark, ("a.csv", STATEMENT)), "b", AT).first()["error_code"] is None
    assert [(r["state"], r["attempt"]) for r in c.job_states().collect()] == [("partial", 1)]


def test_purge_rewrites_only_what_holds_it(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    for b in ("one", "two"):
        c.ingest(frame(spark, (f"{b}.csv", STATEMENT + b.encode()), (f"{b}2.csv", STATEMENT + b"2" + b.encode())), b, AT)
    doomed = c.table("documents").where("original_name = 'one.csv'").select("id")
    gone = doomed.first()["id"]
    assert c.purge(doomed) >= 5
    names = lambda t: sorted(f for f in os.listdir(tmp_path / "cat" / t) if f.startswith("batch="))
    assert names("documents")[1] == "batch=two" and names("documents")[0].startswith("batch=one.p-") and names("bank_transactions")[1] == "batch=two"
    assert c.table("documents").count() == 3 and c.raw("bank_transactions").count() == 3 and c.raw("processing_jobs").where(F.col("document_id") == gone).count() == 0
    assert spark.read.parquet(str(tmp_path / "cat" / "_files")).count() == 3
    other = c.table("documents").where("original_name = 'one2.csv'").first()["id"]
    assert bytes(c.content(other).first()["content"]) == STATEMENT + b"2one"


def test_stream_names_files_beyond_the_limit(spark, tmp_path):
    inbox = tmp_path / "in [x]"
    inbox.mkdir()
    (inbox / "a.csv").write_bytes(STATEMENT)
    (inbox / "big.csv").write_bytes(b"x" * 5000)
    c = Catalog(spark, str(tmp_path / "cat"), limits=Limits(max_csv_bytes=1000, max_pdf_bytes=1000))
    found = stream.stream_files(spark, str(tmp_path / "in*"))
    assert "content" not in found.columns
    stream.start(c, found, str(tmp_path / "cp")).awaitTermination()
    assert [r["original_name"] for r in c.table("documents").collect()] == ["a.csv"]
    held = {r["original_name"]: (r["early"], r["content"] is None) for r in c._read("_files", [f for e in c.manifest.read()[1] for f in e.tables.get("_files", [])]).collect()}
    assert held == {"a.csv": (None, False), "big.csv": ("FILE_TOO_LARGE", True)}
