"""The eight persisted tables and their constraints."""

from __future__ import annotations

from pyspark.sql import SparkSession

_AUDIT = "created_at timestamp, updated_at timestamp"

TABLES: dict[str, str] = {
    "documents": f"id string, filename string, original_name string, document_type string, file_type string, file_size_bytes bigint, checksum_sha256 string, storage_path string, uploaded_by string, uploaded_at timestamp, is_deleted boolean, deleted_at timestamp, {_AUDIT}",
    "processing_jobs": "id string, document_id string, attempt int, status string, started_at timestamp, completed_at timestamp, error_message string, error_detail map<string,string>, retry_count smallint, max_retries smallint, "
    f"warnings array<struct<field:string,message:string>>, parser_version string, is_reprocess boolean, pdf_password_used boolean, pdf_encryption_type string, ocr_used boolean, ocr_engine string, ocr_confidence_avg double, scanned_pages array<int>, {_AUDIT}",
    "bank_statements": "id string, document_id string, processing_job_id string, bank_name string, account_number string, account_holder string, currency string, statement_from date, statement_to date, opening_balance decimal(18,4), closing_balance decimal(18,4), "
    "raw_headers map<int,string>, detected_format string, detected_delimiter string, detected_encoding string, total_rows_parsed int, total_rows_skipped int, extracted_at timestamp, updated_at timestamp",
    "bank_transactions": "id string, bank_statement_id string, transaction_date date, value_date date, description string, raw_description string, reference_number string, transaction_type string, amount decimal(18,4), direction string, "
    "balance_after decimal(18,4), currency string, row_index int, parse_warnings array<string>, created_at timestamp",
    "vendors": f"id string, canonical_name string, raw_names array<string>, country string, tax_id string, {_AUDIT}",
    "invoices": "id string, document_id string, processing_job_id string, vendor_id string, invoice_number string, invoice_date date, due_date date, currency string, subtotal decimal(18,4), tax_amount decimal(18,4), discount_amount decimal(18,4), "
    "total_amount decimal(18,4), raw_vendor_name string, raw_date_text string, raw_total_text string, confidence decimal(4,3), notes string, page_range_start int, page_range_end int, invoice_index int, extracted_at timestamp, updated_at timestamp",
    "invoice_line_items": "id string, invoice_id string, line_number smallint, description string, quantity decimal(12,4), unit_price decimal(18,4), line_total decimal(18,4), tax_rate decimal(6,4), tax_amount decimal(18,4), sku string, unit_of_measure string, created_at timestamp",
    "document_tags": "id string, document_id string, key string, value string, created_at timestamp",
}

#: Rows must fulfil these (SQL).
CHECKS: dict[str, dict[str, str]] = {
    "documents": {"soft_delete": "is_deleted = (deleted_at is not null)", "document_type": "document_type in ('invoice', 'bank_statement')"},
    "processing_jobs": {"status": "status in ('pending', 'processing', 'completed', 'failed', 'partial')"},
    "bank_transactions": {"amount": "amount >= 0", "direction": "direction in ('C', 'D')", "date": "transaction_date is not null", "transaction_type": "transaction_type in ('credit', 'debit', 'transfer', 'fee', 'interest', 'unknown')"},
    "invoices": {"confidence": "confidence between 0 and 1"},
}
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "documents": (("id",), ("checksum_sha256",)), "vendors": (("id",), ("canonical_name",)), "processing_jobs": (("id",),), "bank_statements": (("id",),), "invoices": (("id",),),
    "bank_transactions": (("id",), ("bank_statement_id", "row_index")), "invoice_line_items": (("id",), ("invoice_id", "line_number")), "document_tags": (("id",), ("document_id", "key")),
}
#: child table, child column, parent table.
FOREIGN_KEYS = (
    ("processing_jobs", "document_id", "documents"), ("bank_statements", "document_id", "documents"), ("bank_statements", "processing_job_id", "processing_jobs"),
    ("bank_transactions", "bank_statement_id", "bank_statements"), ("invoices", "document_id", "documents"), ("invoices", "processing_job_id", "processing_jobs"),
    ("invoices", "vendor_id", "vendors"), ("invoice_line_items", "invoice_id", "invoices"), ("document_tags", "document_id", "documents"),
)


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """The eight tables in a database, as Parquet; existing ones stay."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        place = f" LOCATION '{location}/{name}'" if location else ""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], columns).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({fields}) USING parquet{place}")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
