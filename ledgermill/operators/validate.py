"""Checks of raw files: an ordered list of conditions whose first hit is the file's error code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EXTENSIONS, LIMITS, MIME_EXTENSIONS, XLSX_MIME, Limits


def safe_name(name: Column) -> Column:
    """The base name with odd characters replaced, cut to 255 characters."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    clean = F.regexp_replace(base, r"[^a-zA-Z0-9._\-]", "_")
    suffix = F.regexp_extract(clean, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(clean, F.lit(1), F.length(clean) - F.length(suffix))
    cut = F.when(F.length(clean) > 255, F.concat(F.substring(stem, 1, 200), suffix)).otherwise(clean)
    return F.when(F.coalesce(cut, F.lit("")) == "", "upload").otherwise(cut)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def mime(content: Column) -> Column:
    """By the first bytes; text must be UTF-8 and hold a line end, comma or semicolon."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    start = F.decode(F.substring(content, 1, 2000), "ISO-8859-1")
    sample = F.substring(content, 1, 1024).cast("string")
    return (
        F.when(head(4) == "25504446", "application/pdf")
        .when((head(2) == "504B") & (F.contains(start, F.lit("xl/")) | F.contains(start, F.lit("[Content_Types]"))), XLSX_MIME)
        .when(head(2) == "504B", "application/zip")
        .when(head(2).isin("FFFE", "FEFF") | (head(3) == "EFBBBF"), "text/plain")
        .when(F.is_valid_utf8(sample) & F.regexp_like(sample, F.lit("[\\n,;]")), "text/plain")
        .otherwise("application/octet-stream")
    )


def _refusals(limits: Limits) -> tuple[Column, Column]:
    """The codes that a file gets before and after duplicates are looked for; null where it passes.  Of extension,
    length and mime; the cheapest come first."""
    ext, mime_ext = F.col("extension"), F.element_at(F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv]), F.col("mime"))
    early = F.coalesce(
        F.when(~ext.isin(*EXTENSIONS), "INVALID_EXTENSION"),
        F.when(F.col("length") > F.when(ext == ".pdf", limits.max_pdf_bytes).otherwise(limits.max_csv_bytes), "FILE_TOO_LARGE"),
        F.when(F.col("length") == 0, "EMPTY_FILE"),
    )
    late = F.coalesce(
        F.when(mime_ext.isNull(), "UNSUPPORTED_FORMAT"),
        F.when(mime_ext != ext, "FILE_TYPE_MISMATCH"),
        F.when((ext == ".csv") & (F.col("length") < limits.min_csv_bytes), "CSV_PARSE_ERROR"),
    )
    return early, late


def described(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Files (file_id, original_name, length, content, uploaded_at) with what each says of itself: filename, extension,
    checksum_sha256, mime, and the codes ``early`` and ``late``.  A projection."""
    known = files.withColumns({
        "filename": safe_name(F.col("original_name")), "extension": extension(F.col("original_name")),
        "checksum_sha256": checksum(F.col("content")), "mime": mime(F.col("content")),
    })
    early, late = _refusals(limits)
    return known.withColumns({"early": early, "late": late})


def judged(known: DataFrame, documents: DataFrame | None = None, allow_reprocess: bool = False, extracted: DataFrame | None = None, twins: str = "accepted", limits: Limits = LIMITS) -> DataFrame:
    """``described`` files with ``duplicate_of``, ``reprocess_of`` and ``error_code``, and without their content, which
    no exchange carries.

    A file is a duplicate of a live document with its checksum, or of an earlier file of the same input that is
    accepted: a refused file makes no document, so it stands in no one's way.  (``twins="any"``: of any earlier
    file.)  With ``allow_reprocess`` a document's checksum is ``reprocess_of`` instead.  ``extracted``: what an
    extractor says of PDF files (``EXTRACTED``); their codes refuse a file like any other.
    """
    narrow = known.drop("content")
    if extracted is not None:
        of_pdfs = check_pdfs(extracted, limits).select("file_id", F.col("error_code").alias("_pdf"), "pdf_encryption_type", "pdf_password_used")
        narrow = narrow.join(of_pdfs, "file_id", "left").withColumn("late", F.coalesce("late", F.when(F.col("extension") == ".pdf", F.col("_pdf")))).drop("_pdf")
    # Content that was never read (files over the limit) has no checksum; each such file is its own.
    narrow = narrow.withColumns({"_key": F.coalesce("checksum_sha256", "file_id"), "_place": F.struct("uploaded_at", "file_id")})
    if twins not in ("accepted", "any"):
        raise ValueError("twins must be accepted or any")
    may = narrow if twins == "any" else narrow.where("early is null and late is null")
    first = may.groupBy("_key").agg(F.min("_place").alias("_first"))
    narrow = narrow.join(first, "_key", "left")
    earlier = F.when(F.col("_first") < F.col("_place"), F.col("_first.file_id"))
    if documents is None:
        narrow = narrow.withColumn("_document", F.lit(None).cast("string"))
    else:
        live = documents.where("not is_deleted").groupBy("checksum_sha256").agg(F.min("id").alias("_document"))
        narrow = narrow.join(live, "checksum_sha256", "left")
    if allow_reprocess:
        narrow = narrow.withColumns({"reprocess_of": F.col("_document"), "duplicate_of": earlier})
    else:
        narrow = narrow.withColumns({"reprocess_of": F.lit(None).cast("string"), "duplicate_of": F.coalesce("_document", earlier)})
    code = F.coalesce("early", F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE_FILE"), "late")
    return narrow.withColumn("error_code", code).drop("_key", "_place", "_first", "_document", "early", "late")


def validate(files: DataFrame, documents: DataFrame | None = None, allow_reprocess: bool = False, limits: Limits = LIMITS, extracted: DataFrame | None = None, twins: str = "accepted") -> DataFrame:
    """Files (file_id, original_name, length, content, uploaded_at) with their metadata and ``error_code``, without
    content: ``described``, then ``judged``."""
    return judged(described(files, limits), documents, allow_reprocess, extracted, twins, limits)


#: Names of encryption by the version number in a PDF's encryption entry.
PDF_ENCRYPTION = {1: "RC4-40", 2: "RC4-128", 4: "AES-128", 5: "AES-256"}
#: What an extractor says of a PDF: whether it could be opened, the encryption's version (null if there is none),
#: whether the empty password fits, whether one was given and fits, and the number of pages.
EXTRACTED = "file_id string, opened boolean, encryption int, empty_fits boolean, password_given boolean, password_fits boolean, page_count int"


def check_pdfs(extracted: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The extractor's results (columns of ``EXTRACTED``) with ``error_code``, ``pdf_encryption_type`` and
    ``pdf_password_used``.  A password itself is never a column.  A null answer counts as no; pages as 0."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    locked = F.col("encryption").isNotNull() & ~yes("empty_fits")
    names = F.create_map(*[F.lit(x) for kv in PDF_ENCRYPTION.items() for x in kv])
    return extracted.withColumns({
        "error_code": F.coalesce(
            F.when(~yes("opened"), "PDF_CORRUPTED"),
            F.when(locked & ~yes("password_given"), "PDF_PASSWORD_REQUIRED"),
            F.when(locked & ~yes("password_fits"), "PDF_WRONG_PASSWORD"),
            F.when(F.coalesce("page_count", F.lit(0)) > limits.max_pdf_pages, "PDF_TOO_MANY_PAGES"),
        ),
        "pdf_encryption_type": F.when(F.col("encryption").isNotNull(), F.coalesce(F.try_element_at(names, F.col("encryption")), F.concat(F.lit("V="), F.col("encryption").cast("string")))),
        "pdf_password_used": yes("opened") & locked & yes("password_given") & yes("password_fits"),
    })


def scanned_pages(pages: Column, limits: Limits = LIMITS) -> Column:
    """Numbers (from 1) of the pages that hold hardly any text."""
    from ..functions.text import strip

    numbered = F.transform(pages, lambda p, i: F.struct((i + 1).alias("n"), F.length(strip(F.coalesce(p, F.lit("")))).alias("size")))
    return F.transform(F.filter(numbered, lambda x: x["size"] < limits.scanned_page_chars), lambda x: x["n"])
