"""What a batch costs: one that is refused as a whole has no jobs, and the records of a large file are dealt out."""

import datetime as dt
import os

from ledgermill.plans import catalog as Cat
from ledgermill.plans.catalog import Catalog

AT = dt.datetime(2026, 6, 1)
FILES = "file_id string, original_name string, length long, content binary, uploaded_at timestamp"
STATEMENT = b"Date,Description,Amount\n" + b"".join(b"%02d/05/2026,fee,5.00\n" % d for d in range(13, 29))


def test_batches(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a.csv", "a.csv", len(STATEMENT), bytearray(STATEMENT), AT)], FILES)
    c, removed = Catalog(spark, str(tmp_path / "cat")), []
    monkeypatch.setattr(Cat, "GRID_RECORDS", 5)
    monkeypatch.setattr(c, "_remove", removed.append)
    c.ingest(files, "first", AT)
    grid = f"{tmp_path}/cat/_grid/batch=first"
    assert grid in removed and sum(f.endswith(".parquet") for f in os.listdir(grid)) == 4
    assert c.raw("bank_transactions").count() == 16

    again = c.ingest(files, "second", AT)
    assert [(r["document_id"], r["status"], r["error_code"]) for r in again.collect()] == [(None, None, "DUPLICATE_FILE")]
    assert "second" in c.batches() and not os.path.exists(f"{tmp_path}/cat/processing_jobs/batch=second")
    assert c.raw("processing_jobs").count() == 1 and c.job_states().count() == 1 and c.table("documents").count() == 1
    c.ingest(files, "second", AT, allow_reprocess=True)  # the same batch, written again
    assert c.raw("processing_jobs").count() == 2 and c.table("documents").count() == 1
