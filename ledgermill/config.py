"""Limits, tolerances and fixed vocabularies."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    max_pdf_bytes: int = 50 * 1024 * 1024
    max_csv_bytes: int = 25 * 1024 * 1024
    max_csv_rows: int = 100_000
    max_pdf_pages: int = 200
    min_csv_bytes: int = 10
    scanned_page_chars: int = 50
    balance_tolerance: str = "0.10"
    total_tolerance: str = "0.05"


@dataclass(frozen=True)
class DateRules:
    """Stands in for what depends on today: the day that fills missing parts, and the last two-digit year
    read as 20yy."""

    default: dt.date = dt.date(2026, 1, 1)
    pivot: int = 75


LIMITS = Limits()
DATE_RULES = DateRules()

#: Header synonyms of each logical column, the more specific first.  Fixed values.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "date": (
        "transaction date", "txn date", "trans date", "date",
        "posting date", "post date", "entry date", "booking date",
        "datum", "buchungsdatum", "buchungstag", "wertstellungsdatum",
        "value dt", "tran date", "val date",
    ),
    "value_date": (
        "value date", "settlement date", "effective date",
        "value dt", "wertstellung", "val date",
    ),
    "description": (
        "transaction details", "transaction description", "narration",
        "description", "particulars", "details", "remarks", "memo",
        "reference details", "trans description",
        "buchungstext", "verwendungszweck", "betreff",
        "tran particular", "transaction particulars",
    ),
    "reference": (
        "reference number", "ref number", "ref no", "reference",
        "cheque no", "cheque number", "check no", "transaction id",
        "txn id", "trans id", "utr", "utr number",
        "chq./ref.no.", "chq/ref no", "chq.ref.no", "cheque ref no",
    ),
    "amount": (
        "transaction amount", "txn amount", "trans amount",
        "amount (inr)", "amount (usd)", "amount",
        "betrag", "umsatz",
    ),
    "debit": (
        "debit amount", "withdrawal amount", "withdrawal (dr)",
        "debit", "dr", "withdrawal", "dr amount", "debit(dr)",
        "withdrawal amt (dr)", "debit amt", "dr amt",
        "withdrawals", "debit (dr)",
    ),
    "credit": (
        "credit amount", "deposit amount", "deposit (cr)",
        "credit", "cr", "deposit", "cr amount", "credit(cr)",
        "deposit amt (cr)", "credit amt", "cr amt",
        "deposits", "credit (cr)",
    ),
    "balance": (
        "running balance", "available balance", "closing balance",
        "balance", "bal", "closing bal",
        "kontostand", "saldo", "endbestand",
    ),
    "currency": ("currency", "ccy", "curr", "währung", "wahrung"),
    "transaction_type": ("transaction type", "txn type", "type", "trans type"),
}

#: First cells that mark a repeated header.  Fixed values.
REPEATED_HEADERS = ("date", "txn date", "transaction date", "value date")

#: Beginnings of first cells of summary rows.  Fixed values.
SUMMARY_ROW = r"(?iU)^\s*(total|balance|closing|opening|subtotal|grand\s+total|net\s+total|brought\s+forward|carried\s+forward|statement\s+summary|page\s+\d+)\b"

#: Explicit transaction types, then keywords of descriptions in order.  Fixed values.
EXPLICIT_TYPES = {"credit": "credit", "cr": "credit", "debit": "debit", "dr": "debit", "transfer": "transfer", "fee": "fee", "interest": "interest"}
TYPE_KEYWORDS = (
    (r"\b(transfer|trf|trsf|neft|rtgs|imps|upi)\b", "transfer"),
    (r"\b(fee|charge|penalty|fine|commission)\b", "fee"),
    (r"\b(interest|int earned|int paid)\b", "interest"),
    (r"\b(atm|cash withdrawal|cash deposit)\b", "debit"),
    (r"\b(salary|payroll|stipend)\b", "credit"),
)

#: Formats, each with the headers that must all be there; the first that fits wins.  Fixed values.
BANK_FORMATS = (
    ("HDFC_STANDARD", ("narration", "chq./ref.no.")),
    ("ICICI_STANDARD", ("transaction remarks",)),
    ("SBI_STANDARD", ("particulars", "cheque no")),
    ("CHASE_US", ("memo", "amount")),
    ("GENERIC_SPLIT", ("description", "debit", "credit")),
    ("GENERIC_SINGLE", ("description", "amount")),
)

#: Invoice labels.  Fixed values.
INVOICE_NUMBER = (
    r"(?i)(?:invoice[ \t]*number|invoice[ \t]*no\.?|invoice[ \t]*#|inv[ \t]*no\.?|inv[ \t]*#|bill[ \t]*no\.?|invoice[ \t]*id)[ \t]*[:#-]?[ \t]*([A-Za-z0-9\-_]+)",
    r"(?i)inv-?([A-Za-z0-9\-_]+)",
)
INVOICE_DATE = r"(?i)(?:invoice[ \t]*date|issue[ \t]*date|billing[ \t]*date|date[ \t]*of[ \t]*issue|date)[ \t]*[:\-]?[ \t]*([^\n\r]+)"
DUE_DATE = r"(?i)(?:due[ \t]*date|payment[ \t]*due|due[ \t]*by|pay[ \t]*by|expiry[ \t]*date)[ \t]*[:\-]?[ \t]*([^\n\r]+)"
SUBTOTAL = r"(?iU)\b(?:subtotal|sub-total|net[ \t]*amount|net[ \t]*total)\b[ \t]*[:\-]?[ \t]*([^\n\r]+)"
TAX = r"(?iU)\b(?:tax|vat|gst|sales[ \t]*tax|tax[ \t]*amount|vat[ \t]*amount)\b[ \t]*[:\-]?[ \t]*([^\n\r]+)"
DISCOUNT = r"(?iU)\b(?:discount|rebate|promo|discount[ \t]*amount)\b[ \t]*[:\-]?[ \t]*([^\n\r]+)"
TOTAL = r"(?iU)\b(?:total|amount[ \t]*due|total[ \t]*due|grand[ \t]*total|balance[ \t]*due|invoice[ \t]*total)\b[ \t]*[:\-]?[ \t]*([^\n\r]+)"
VENDOR = (
    r"(?i)(?:vendor|seller|billed[ \t]*from|service[ \t]*provider)[ \t]*[:\-]?[ \t]*([^\n\r]+)",
    r"(?i)(?:from)[ \t]*[:\-][ \t]*([^\n\r]+)",
)
NOT_A_VENDOR = r"(?iU)(invoice|statement|due|date|amount|total|#|\d{5,})"
DATE_IN_TEXT = r"(?U)(\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\d{1,2}\s+[A-Za-z]+\s+\d{2,4}|[A-Za-z]+\s+\d{1,2},\s*\d{2,4})"
AMOUNT_IN_TEXT = r"(?U)([+-]?\s*[\d,.\s]+(?:\s*[DdRrCcRr]+)?|[£$€₹¥₩]*\s*[+-]?\s*[\d,.]+)"
SUMMARY_LINE = r"(?iU)^\s*(subtotal|total|tax|gst|vat|balance|discount)\b"
TEXT_TABLE_HEADER = r"(?iU)\b(?:description|item|details|particulars)\b.*\b(?:qty|quantity|units)\b.*\b(?:price|rate|cost)\b.*\b(?:total|amount)\b"
TEXT_TABLE_ROW = r"(?U)^(.+?)\s+(\d+)\s+([£$€₹¥₩]?\s*[+-]?\s*[\d,.]+)\s+([£$€₹¥₩]?\s*[+-]?\s*[\d,.]+)$"
#: Currency marks in the order in which ties are decided.  Fixed values.
CURRENCY_MARKS = (("USD", ("$", "USD")), ("EUR", ("€", "EUR")), ("GBP", ("£", "GBP")), ("INR", ("₹", "INR")), ("JPY", ("¥", "JPY")))
#: Keywords of a line table's columns; the first field with a keyword in the cell wins.  Fixed values.
LINE_COLUMNS: dict[str, tuple[str, ...]] = {
    "description": ("description", "item", "details", "desc", "particulars", "product", "service", "name"),
    "quantity": ("qty", "quantity", "qty.", "units", "count", "qnty"),
    "unit_price": ("unit price", "price", "unit_price", "rate", "cost", "unit cost", "price/unit"),
    "line_total": ("total", "amount", "line total", "total amount", "subtotal", "value"),
    "sku": ("sku", "item code", "code", "part no", "part number", "id", "sku/code"),
    "unit_of_measure": ("unit", "uom", "measure"),
    "tax_amount": ("tax", "vat", "gst", "tax amount", "tax_amount"),
    "tax_rate": ("tax rate", "tax %", "vat %", "gst %", "tax_rate"),
}

#: code, HTTP status, stage.  Fixed values.
ERROR_CODES = (
    ("INTERNAL_ERROR", 500, "any"), ("EMPTY_FILE", 400, "validate"), ("INVALID_EXTENSION", 400, "validate"), ("FILE_TOO_LARGE", 413, "validate"),
    ("UPLOAD_INCOMPLETE", 400, "validate"), ("DUPLICATE_FILE", 409, "validate"), ("FILE_TYPE_MISMATCH", 415, "validate"),
    ("UNSUPPORTED_FORMAT", 415, "validate"), ("PDF_PASSWORD_REQUIRED", 422, "pdf"), ("PDF_WRONG_PASSWORD", 422, "pdf"), ("PDF_CORRUPTED", 422, "pdf"),
    ("PDF_TOO_MANY_PAGES", 422, "pdf"), ("OCR_FAILED", 422, "pdf"), ("CSV_PARSE_ERROR", 422, "csv"), ("CSV_ENCODING_ERROR", 422, "csv"),
    ("CSV_NO_DATA_ROWS", 422, "csv"), ("CSV_MISSING_REQUIRED_COLUMNS", 422, "csv"), ("PARTIAL_PARSE", 207, "parse"),
)
#: Extensions, and the extension that each MIME type stands for.  Fixed values.
EXTENSIONS = (".pdf", ".csv", ".xlsx")
XLSX_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
MIME_EXTENSIONS = {"application/pdf": ".pdf", "text/csv": ".csv", "text/plain": ".csv", "application/csv": ".csv", XLSX_MIME: ".xlsx", "application/vnd.ms-excel": ".xlsx"}

#: The texts of warnings and notes; names in braces stand for what they tell.
MESSAGES = {
    "both_sides": "Both debit and credit columns were non-empty; larger value used.",
    "serial_date": "Date was an Excel serial number ({serial}); converted to {date}.",
    "day_first": "Day-first assumed: parsed as {date}. Ambiguous — could also be {other}.",
    "month_first": "Month-first assumed: parsed as {date}. Ambiguous — could also be {other}.",
    "date": "date: {text}",
    "bad_value_date": "value_date: Could not parse, ignored",
    "bad_split": "amount: Split parse failed — Cannot parse amount from: '{text}'",
    "bad_amount": "amount: Cannot parse amount from: '{text}'",
    "no_amount": "amount: Missing or null — row retained without amount",
    "amount": "amount: {text}",
    "inferred": "amount: Direction inferred (no explicit CR/DR marker)",
    "bad_balance": "balance: Could not parse running balance",
    "gap": "Balance discontinuity at row {row}: expected ~{expected}, got {found}. Diff: {gap}. Possible missing rows.",
    "currencies": "Multiple currencies detected: {{'{all}'}}. Dominant: {dominant}. Per-row currency stored on each transaction.",
    "truncated": "File has {rows} data rows; truncated to {limit}.",
    "lines_and_subtotal": "Reconciliation note: Sum of line items ({lines}) differs from Subtotal ({stated}) by {gap}",
    "total": "Reconciliation note: Calculated total ({calculated}) differs from Total ({stated}) by {gap}",
    "missing_fields": "Missing core fields: {fields}",
    "warnings": "Warnings: {all}",
    "no_warnings": "Parsed via heuristics and tables extraction.",
}
