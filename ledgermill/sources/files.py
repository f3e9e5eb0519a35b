"""Raw files: scan, decode, tokenise."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import tempfile
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import let
from .shipping import ship

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
DELIMITERS = (",", ";", "\t", "|", ":")
GRID = "file_id string, line_no int, cells array<string>, delimiter string"
#: Files as they are kept: their contents and what each says of itself.
HELD = (
    "file_id string, original_name string, length long, content binary, uploaded_at timestamp, filename string, extension string, "
    "checksum_sha256 string, mime string, early string, late string, encoding string"
)
#: Records of a batch that a tokeniser hands on.
BATCH = 4096


def scan(spark: SparkSession, path: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """Files with ``file_id``, ``original_name``, ``length`` and ``content``.  A size limit reaches the scan: of
    what is over it the content is null, and never read."""
    found = spark.read.format("binaryFile").load(path)
    if max_bytes is None:
        return named(found)
    small, large = found.where(F.col("length") <= max_bytes), found.where(F.col("length") > max_bytes)
    return named(small).unionByName(named(large.select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))))


def named(files: DataFrame) -> DataFrame:
    return files.select(F.sha2("path", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("original_name"), "length", "content", F.col("modificationTime").alias("uploaded_at"))


#: The bytes 80 to 9F of windows-1252, in order, but for the five that stand for nothing.
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Bytes of a file that its encoding is guessed from.
SAMPLE_BYTES = 1 << 16


def encoding_of(content: Column) -> Column:
    """The name of a content's encoding: by its byte-order mark, else by what its bytes are.

    Zero bytes at odd or at even places alone, in one of twenty pairs or more, are UTF-16 (little or big end first):
    separators, digits and line ends have one whatever the script.  Valid UTF-8 is that, or ascii.  Of single-byte
    texts those with bytes from 80 to 9F, where Latin-1 has control characters, are windows-1252, unless one of
    these stands for nothing there; else they are Latin-1, which any bytes are.
    """
    head = lambda n: F.hex(F.substring(content, 1, n))
    text = content.cast("string")
    sample = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    zeros = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\0"), F.lit("")))
    at = lambda which: zeros(F.regexp_replace(sample, "(?s)(.)(.)", f"${which}"))
    pairs = F.length(sample) / 2
    clear = lambda many, few: (20 * many >= pairs) & (many >= 8 * few)
    wide = F.contains(sample, F.lit("\0")) & (F.octet_length(content) % 2 == 0)
    single = F.decode(content, "ISO-8859-1")
    undefined = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in CP1252_BYTES)
    return (
        F.when(head(3) == "EFBBBF", "utf-8-sig").when(head(2).isin("FFFE", "FEFF"), "utf-16")
        .when(wide & clear(at(2), at(1)), "utf-16-le").when(wide & clear(at(1), at(2)), "utf-16-be")
        .when(F.is_valid_utf8(text), F.when(F.regexp_like(text, F.lit(r"^[\x00-\x7f]*$")), "ascii").otherwise("utf-8"))
        .when(F.regexp_like(single, F.lit("[\x80-\x9f]")) & ~F.regexp_like(single, F.lit(f"[{undefined}]")), "windows-1252").otherwise("latin-1")
    )


def decoded(content: Column) -> Column:
    """A struct of ``text`` and ``encoding`` (``encoding_of``)."""
    rest = F.substring(content, F.lit(4), F.length(content))
    single = F.decode(content, "ISO-8859-1")

    def read(name: Column) -> Column:
        text = (
            F.when(name == "utf-8-sig", F.decode(rest, "UTF-8")).when(name == "utf-16", F.decode(content, "UTF-16"))
            .when(name == "utf-16-le", F.decode(content, "UTF-16LE")).when(name == "utf-16-be", F.decode(content, "UTF-16BE"))
            .when(name.isin("ascii", "utf-8"), content.cast("string"))
            .when(name == "windows-1252", F.translate(single, CP1252_BYTES, CP1252_CHARACTERS)).otherwise(single)
        )
        return F.struct(text.alias("text"), name.alias("encoding"))

    return let(encoding_of(content), read)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name where all executors see it.  Only a local session may go without
    ``spark.checkpoint.dir``: on a cluster a temporary folder is another one on every machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgermill-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the folder that the cluster shares and read again, so that a Python step runs once
    whatever reads it, and a lost executor costs a re-read."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(rows: list[list[str]]) -> tuple[int, float]:
    """The commonest width of rows that are not empty, and its share."""
    widths = Counter(len(r) for r in rows if r)
    if not widths:
        return 0, 0.0
    width, n = widths.most_common(1)[0]
    return width, n / sum(widths.values())


def _head(text: str, delimiter: str, rows: int = 20) -> list[list[str]]:
    reader, found = csv.reader(io.StringIO(text), delimiter=delimiter), []
    try:
        for row in reader:
            found.append(row)
            if len(found) == rows:
                break
    except csv.Error:
        pass
    return found


def delimiter_of(text: str) -> str:
    """The sniffer's guess on the first 4096 characters if it gives even rows, else the best-scoring one."""
    sample = text[: 1 << 16]
    try:
        guess = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
        width, share = _width(_head(sample, guess))
        if width >= 2 and share >= 0.7:
            return guess
    except csv.Error:
        pass
    best, top = ",", 0.0
    for d in DELIMITERS:
        rows = _head(sample, d)
        width, share = _width(rows)
        if max(map(len, rows), default=0) >= 2 and width * share > top:
            best, top = d, width * share
    return best


def records(text: str) -> Iterator[tuple[int, list[str], str]]:
    """Number, cells and delimiter of each record of a delimited text; a record that cannot be read has no cells."""
    mark = delimiter_of(text)
    reader, number = csv.reader(io.StringIO(text, newline=""), delimiter=mark), 0
    while True:
        try:
            row = next(reader)
        except StopIteration:
            return
        except csv.Error:
            row = []
        number += 1
        yield number, row, mark


def tokenise(files: DataFrame) -> DataFrame:
    """Records of delimited text (columns file_id, text) as ``GRID``: blank records keep their numbers, which
    count from 1.  The only step that leaves the JVM; records stream out in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)

        def made(ids: list, numbers: list, cells: list, marks: list) -> pa.RecordBatch:
            arrays = [pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string())), pa.array(marks, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["file_id", "line_no", "cells", "delimiter"])

        out: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, row, mark in records(text) if text else ():
                    for column, value in zip(out, (file_id, number, row, mark), strict=True):
                        column.append(value)
                    if len(out[0]) >= BATCH:
                        yield made(*out)
                        out = ([], [], [], [])
        if out[0]:
            yield made(*out)

    ship(files.sparkSession)
    return files.select("file_id", "text").mapInArrow(run, GRID)


_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Numbers of built-in cell formats that show dates or times.
_DATE_FORMATS = frozenset({*range(14, 23), *range(45, 48)})


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")


def _active_sheet(z: zipfile.ZipFile) -> str | None:
    """The part that holds the active sheet: the first one if the workbook names none."""
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: [int(x) for x in re.findall("[0-9]+", n)] or [0])
    book = _part(z, "xl/workbook.xml")
    view, listed = book.find(f".//{_SPACE}workbookView"), book.findall(f".//{_SPACE}sheet")
    at = int(view.get("activeTab", 0)) if view is not None else 0
    if at < len(listed):
        wanted = next((v for k, v in listed[at].attrib.items() if k.endswith("}id")), None)
        for r in _part(z, "xl/_rels/workbook.xml.rels"):
            if r.get("Id") == wanted:
                name = r.get("Target", "")
                return name.lstrip("/") if name.startswith("/") else f"xl/{name}"
    return sheets[at] if at < len(sheets) else sheets[0] if sheets else None


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    styles = _part(z, "xl/styles.xml")
    own = {int(f.get("numFmtId", 0)): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{_SPACE}numFmt")}
    cells = styles.find(f"{_SPACE}cellXfs")
    numbers = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {i for i, n in enumerate(numbers) if n in _DATE_FORMATS or re.search("[dmyhs]", own.get(n, ""), re.IGNORECASE)}


def _as_date(serial: str, from_1904: bool) -> str:
    """A serial number as a date with its time; text that is no number stays."""
    try:
        days = float(serial)
        return str((dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)) + dt.timedelta(seconds=round(days * 86400)))
    except (ValueError, OverflowError):
        return serial


def _xlsx_rows(content: bytes) -> list[list[str]]:
    """Cells of a workbook's active sheet as text; cells with a date's format are dates."""
    space = _SPACE
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in _part(z, "xl/sharedStrings.xml").iter(f"{space}si")]
        sheet, dates = _active_sheet(z), _date_styles(z)
        settings = _part(z, "xl/workbook.xml").find(f"{space}workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        root = ElementTree.fromstring(z.read(sheet)) if sheet else ElementTree.Element("none")
    rows: list[list[str]] = []
    for row in root.iter(f"{space}row"):
        while len(rows) < int(row.get("r", len(rows) + 1)) - 1:
            rows.append([])
        cells: list[str] = []
        for c in row.iter(f"{space}c"):
            at = 0
            for ch in "".join(filter(str.isalpha, c.get("r", ""))):
                at = at * 26 + ord(ch) - 64
            cells += [""] * (max(at, 1) - 1 - len(cells))
            kind, value = c.get("t"), c.find(f"{space}v")
            text = "".join(t.text or "" for t in c.iter(f"{space}t")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
            if kind in (None, "n") and text and int(c.get("s", 0)) in dates:
                text = _as_date(text, from_1904)
            cells.append(strings[int(text)] if kind == "s" and text else {"1": "True", "0": "False"}.get(text, text) if kind == "b" else text)
        rows.append(cells)
    return rows


def xlsx_text(files: DataFrame) -> DataFrame:
    """(file_id, text): workbooks (file_id, content), their active sheets, written again as comma-separated text; null text if a
    workbook cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content in batch.column(1).to_pylist():
                try:
                    out = io.StringIO()
                    csv.writer(out, lineterminator="\n").writerows(_xlsx_rows(content))
                    texts.append(out.getvalue())
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["file_id", "text"])

    ship(files.sparkSession)
    return files.select("file_id", "content").mapInArrow(run, "file_id string, text string")
