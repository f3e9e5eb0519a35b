"""The catalog: the eight tables as Parquet in one folder, ingest, and the retrieval queries.

A batch writes each table under its own folder (``batch=<id>``) in overwrite mode, so a batch that is run again
replaces what it left.  The last thing that a batch writes is its entry in the manifest: folders that no entry names
are never read, so a batch becomes visible in all tables at once, and one that broke off in none.  A deletion is a
row of a table of its own; ``purge`` takes rows out of files.  Small batches are folded into larger folders, so that
a read never opens many.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from ..config import DATE_RULES, LIMITS, DateRules, Limits
from ..operators import invoices as I, statements as S
from ..operators.validate import EXTRACTED, check_pdfs, described, judged, scanned_pages
from ..schemas import CHECKS, TABLES
from ..sources import files as Files
from .manifest import Entry, Manifest

CSV_VERSION, PDF_VERSION = "ledgermill-csv-1", "ledgermill-invoice-1"
#: Tables beside the eight: deletions, and what became of jobs.
SIDE_TABLES = {
    "deletions": "document_id string, deleted_at timestamp",
    "job_events": "job_id string, document_id string, state string, attempt int, at timestamp, message string",
}
#: The order of a job's states within an attempt; all but the first two end it.
STATES = ("pending", "processing", "completed", "partial", "failed")
#: Records in a file of the grid at most, so that the parsing of few large files is shared by all cores.
GRID_RECORDS = 16_384
#: Entries of one level that are folded into one of the next.
FAN = 32


def make_id(*parts: Column | str) -> Column:
    """An id that depends on nothing but what it names."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """One job per document: the newest, of equally new ones that with the greatest id."""
    newest = W.partitionBy("document_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return jobs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def page(documents: DataFrame, limit: int = 20, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """A page in a total order: newest first, then by id.  ``after``: (uploaded_at, id) of the last document of the page
    before, a range that reaches the scan; an offset sorts all that it skips."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        documents = documents.where((F.col("uploaded_at") <= at) & ((F.col("uploaded_at") < at) | (F.col("id") > last)))
    ordered = documents.orderBy(F.col("uploaded_at").desc(), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def walk(documents: DataFrame, limit: int = 100) -> DataFrame:
    """All documents in the order of ``page``, each with the number of its page (from 0): what asking for page after page
    gives, by one sort.  Places within a sorted part and the parts' sizes give places in the whole."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    # The place of a row that is generated counts up within its part, whose number is above the lower 33 bits.
    placed = documents.orderBy(F.col("uploaded_at").desc(), "id").withColumn("_at", F.monotonically_increasing_id())
    placed = Files.staged(placed, "walk").withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # as many rows as parts
    return placed.join(starts, "_part").withColumn("page", F.expr(f"(_start + _at) div {limit}")).drop("_part", "_at", "_start")


def job_states(events: DataFrame) -> DataFrame:
    """The current state of every job from its events: the last of the latest attempt."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    last = F.max_by(F.struct("document_id", "state", "attempt", "at", "message"), F.struct("attempt", rank, "at")).alias("_last")
    return events.groupBy("job_id").agg(last).select("job_id", "_last.*")


def merged_vendors(vendors: DataFrame) -> DataFrame:
    """One row per vendor: batches that ran at the same time may each have added it.  The first added names it, and all
    spellings are kept."""
    def value(c: str) -> Column:
        return F.min_by(c, F.struct("created_at", "canonical_name")).alias(c)

    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("raw_names", F.array("canonical_name")))))).alias("raw_names")
    ends = [F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")]
    grouped = vendors.groupBy("id").agg(*[value(c) for c in ("canonical_name", "country", "tax_id")], names, *ends)
    return grouped.select(*[c.split()[0] for c in TABLES["vendors"].split(", ")])


def page_count(documents: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """``count``, the number of documents on a page."""
    return page(documents, limit, offset).agg(F.count(F.lit(1)).alias("count"))


def with_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every job (its columns, with document_id) beside its document; documents without jobs have none."""
    return documents.withColumnRenamed("id", "document_id").join(jobs, "document_id")


def with_results(documents: DataFrame, statements: DataFrame, invoices: DataFrame) -> DataFrame:
    """Documents beside their statements and invoices (id, document_id, currency), with ``statement_id``,
    ``invoice_id`` and ``currency``; a document without results stays, with nulls."""
    of = lambda t, name: t.select(F.col("document_id").alias("id"), F.col("id").alias(name), F.col("currency").alias(f"_{name}"))
    joined = documents.join(of(statements, "statement_id"), "id", "left").join(of(invoices, "invoice_id"), "id", "left")
    return joined.withColumn("currency", F.coalesce("_statement_id", "_invoice_id")).drop("_statement_id", "_invoice_id")


def with_parent(children: DataFrame, parents: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Children beside their parent: transactions and statements, lines and invoices, lines and vendors."""
    return children.join(parents.withColumnRenamed("id", key), key, how)


def resolve_vendors(names: DataFrame, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, new): ``names`` (column name) with the vendor that has it but for case, and vendors to add
    for names that none has.  Of spellings that differ by case alone the smallest names the new vendor."""
    keyed = names.where("name is not null").withColumn("_key", F.lower("name"))
    by_key = vendors.groupBy(F.lower("canonical_name").alias("_key")).agg(F.min_by("id", "canonical_name").alias("vendor_id"))
    known = keyed.join(by_key, "_key").drop("_key")
    new = keyed.join(by_key, "_key", "left_anti").groupBy("_key").agg(F.min("name").alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("raw_names"))
    return known, new.select(make_id(F.lit("vendor"), "_key").alias("id"), "canonical_name", "raw_names")


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with their children as an array in order (an empty one if there are none)."""
    fields = [order, *[c for c in children.columns if c not in (order, key)]]
    held = children.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = "array<" + children.select(F.struct(*fields).alias("s")).schema["s"].dataType.simpleString() + ">"
    joined = parents.join(held, parents["id"] == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))


def tags(documents: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Documents with their tags as a map."""
    held = document_tags.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("tags"))
    return documents.join(held.withColumnRenamed("document_id", "id"), "id", "left")


class Catalog:
    def __init__(self, spark: SparkSession, root: str, limits: Limits = LIMITS, rules: DateRules = DATE_RULES):
        self.spark, self.root, self.limits, self.rules = spark, root.rstrip("/"), limits, rules
        self.manifest = Manifest(spark, self.root)
        self._written: dict[str, dict[str, bool]] = {}
        self._metrics: dict[str, dict[str, dict]] = {}

    # --- tables

    def _schema(self, name: str) -> str:
        return (SIDE_TABLES | TABLES | {"_files": Files.HELD})[name]

    def batches(self) -> list[str]:
        """The batches that are complete."""
        return sorted({b for e in self.manifest.read()[1] for b in e.batches if b not in e.hidden})

    def commit(self, batch: str) -> None:
        """Makes what ``append`` wrote of a batch visible."""
        tables, metrics = self._written.pop(batch, {}), self._metrics.pop(batch, {})
        self.manifest.add(Entry((batch,), {t: [batch] for t in sorted(tables)}, metrics=metrics))
        self.fold()

    def uncommit(self, batch: str) -> None:
        """Hides a batch and its events, before it is written again."""
        self.manifest.hide(lambda b: b == batch or b.startswith(f"{batch}--events-"))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self._schema(name)}, _batch string").parquet(*[f"{self.root}/{name}/batch={f}" for f in sorted(folders)])

    def _rows(self, name: str, entries: list[Entry], but: str | None = None) -> list[DataFrame]:
        """A table's rows in entries, with ``_batch``: one frame for all that are whole, one for each that is not."""
        held = [e for e in entries if name in e.tables]
        whole = [f for e in held if not e.hidden and but not in e.batches for f in e.tables[name]]
        found = [self._read(name, whole)] if whole else []
        for e in held:
            gone = {*e.hidden, but} & set(e.batches)
            if gone and gone != set(e.batches):
                found.append(self._read(name, e.tables[name]).where(~F.col("_batch").isin(*gone)))
        return found

    def raw(self, name: str, but: str | None = None, within: str | None = None) -> DataFrame:
        """A table's complete batches, without batch ``but``, and with batch ``within`` though it is not complete."""
        found = self._rows(name, list(self.manifest.read()[1]), but)
        if within is not None and name in self._written.get(within, {}):
            found.append(self._read(name, [within]))
        if not found:
            return self.spark.createDataFrame([], self._schema(name))
        return reduce(DataFrame.unionByName, found).drop("_batch")

    def table(self, name: str) -> DataFrame:
        if name == "vendors":
            return merged_vendors(self.raw(name))
        if name != "documents":
            return self.raw(name)
        gone = self.raw("deletions").groupBy(F.col("document_id").alias("id")).agg(F.min("deleted_at").alias("_at"))
        joined = self.raw("documents").join(gone, "id", "left")
        return joined.withColumns({"is_deleted": F.col("_at").isNotNull(), "deleted_at": F.col("_at")}).select(*[c.split()[0] for c in TABLES["documents"].split(", ")])

    def append(self, name: str, df: DataFrame, batch: str) -> None:
        """Writes a batch's rows of a table, and counts them and those that break its checks on the way."""
        empty = self.spark.createDataFrame([], self._schema(name))
        given = df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema])
        seen = Observation()
        # The state of deletion is not stored with documents, so that check holds for the view alone.
        rules = {k: r for k, r in CHECKS.get(name, {}).items() if k != "soft_delete"}
        given = given.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.expr(r)).alias(k) for k, r in rules.items()])
        given.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        self._written.setdefault(batch, {})[name] = True
        self._metrics.setdefault(batch, {})[name] = seen.get

    def metrics(self) -> dict[str, dict]:
        """What was counted of each batch (by table: rows, and violations by check), of folded ones in sum."""
        return {"+".join(e.batches): e.metrics for e in self.manifest.read()[1]}

    def fold(self, fan: int = FAN) -> None:
        """Merges the oldest ``fan`` entries of a level into one of the next, as long as there are as many.  What
        readers may still read stays until ``vacuum``."""
        while True:
            entries = self.manifest.read()[1]
            level = next((n for n in sorted({e.level for e in entries}) if sum(e.level == n for e in entries) >= fan), None)
            if level is None:
                return
            old = tuple(e for e in entries if e.level == level)[:fan]
            folder = f"folded-{uuid.uuid4().hex}"
            tables: dict[str, list[str]] = {}
            for name in sorted({t for e in old for t in e.tables}):
                if name == "_files":  # contents are found by their own folder's name
                    tables[name] = [f for e in old for f in e.tables.get(name, [])]
                    continue
                rows = self._rows(name, list(old))
                if rows:
                    reduce(DataFrame.unionByName, rows).write.parquet(f"{self.root}/{name}/batch={folder}")
                    tables[name] = [folder]
            sums: dict[str, dict] = {}
            for e in old:
                for t, counted in e.metrics.items():
                    for k, n in counted.items():
                        sums.setdefault(t, {})[k] = sums.get(t, {}).get(k, 0) + n
            kept = tuple(b for e in old for b in e.batches if b not in e.hidden)
            if not self.manifest.exchange(old, (Entry(kept, tables, level + 1, metrics=sums),)):
                return  # another writer was faster; what was written goes with vacuum

    def _store(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _remove(self, path: str) -> None:
        p, store = self._store(path)
        store.delete(p, True)

    def vacuum(self) -> int:
        """Removes folders that no entry names, for when no reader and no other writer is at work; says how many."""
        live = {(t, f) for e in self.manifest.read()[1] for t, folders in e.tables.items() for f in folders} | {(t, b) for b, ts in self._written.items() for t in ts}
        removed = 0
        for name in (*TABLES, *SIDE_TABLES, "_files"):
            path, store = self._store(f"{self.root}/{name}")
            for f in store.listStatus(path) if store.exists(path) else []:
                folder = f.getPath().getName().removeprefix("batch=")
                if (name, folder) not in live:
                    store.delete(f.getPath(), True)
                    removed += 1
        return removed

    def purge(self, documents: DataFrame) -> int:
        """Takes documents (column id) and all that depends on them out of the files.  Only folders that hold such rows
        are written again, under new names that one change of the manifest makes visible; the old ones are removed.
        Returns the number of folders that were written."""
        ids = Files.staged(documents.select(F.col("id").alias("k")).distinct(), "purge")
        of = lambda name, column, keys: self.raw(name).join(keys.withColumnRenamed("k", column), column, "left_semi")
        key = lambda df, column="id": df.select(F.col(column).alias("k")).where("k is not null").distinct()
        statements, invoices = (Files.staged(key(of(t, "document_id", ids)), "purge") for t in ("bank_statements", "invoices"))
        files = Files.staged(key(of("documents", "id", ids).select(F.substring_index("storage_path", "#", -1).alias("id"))), "purge")
        doomed = {
            "documents": ("id", ids), **{t: ("document_id", ids) for t in ("processing_jobs", "bank_statements", "invoices", "document_tags", "deletions", "job_events")},
            "bank_transactions": ("bank_statement_id", statements), "invoice_line_items": ("invoice_id", invoices), "_files": ("file_id", files),
        }
        entries, made, replaced = self.manifest.read()[1], {}, []
        for name, (column, keys) in doomed.items():
            folders = [f for e in entries for f in e.tables.get(name, [])]
            if not folders:
                continue
            rows = self._read(name, folders).select(column, F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]+)/[^/]*$", 1).alias("_folder"))
            hit = [r["_folder"] for r in rows.join(keys.withColumnRenamed("k", column), column, "left_semi").select("_folder").distinct().collect()]
            for f in hit:
                new = f"{f.split('.p-')[0]}.p-{uuid.uuid4().hex[:12]}"
                self._read(name, [f]).join(keys.withColumnRenamed("k", column), column, "left_anti").write.parquet(f"{self.root}/{name}/batch={new}")
                made[name, f] = new
        for e in entries:
            tables = {t: [made.get((t, f), f) for f in folders] for t, folders in e.tables.items()}
            if tables != e.tables:
                replaced.append((e, Entry(e.batches, tables, e.level, e.hidden, e.metrics)))
        if replaced and not self.manifest.exchange(tuple(o for o, _ in replaced), tuple(n for _, n in replaced)):
            raise RuntimeError("another writer changed a folder that is being purged; run it again")
        for name, f in made:
            self._remove(f"{self.root}/{name}/batch={f}")
        return len(made)

    # --- retrieval

    def get_document(self, document_id: str) -> DataFrame:
        return self.table("documents").where((F.col("id") == document_id) & ~F.col("is_deleted"))

    def content(self, document_id: str) -> DataFrame:
        """The bytes of a live document (column content), from the table that its storage_path names before the #."""
        found = self.get_document(document_id).select("storage_path").first()
        if found is None:
            return self.spark.createDataFrame([], "content binary")
        place, file_id = found["storage_path"].rsplit("#", 1)
        batch = place.rsplit("/batch=", 1)[1]
        folders = [f for e in self.manifest.read()[1] for f in e.tables.get("_files", []) if f.split(".p-")[0] == batch]
        return self._read("_files", folders).where(F.col("file_id") == file_id).select("content")

    def latest_job(self, document_id: str) -> DataFrame:
        return self.raw("processing_jobs").where(F.col("document_id") == document_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)

    def list_documents(self, document_type: str | None = None, status: str | None = None, currency: str | None = None, uploaded_after=None, uploaded_before=None, limit: int = 20, offset: int = 0, after: tuple | None = None) -> DataFrame:
        docs = self.table("documents").where("not is_deleted")
        if document_type:
            docs = docs.where(F.col("document_type") == document_type)
        if uploaded_after is not None:
            docs = docs.where(F.col("uploaded_at") >= F.lit(uploaded_after))
        if uploaded_before is not None:
            docs = docs.where(F.col("uploaded_at") <= F.lit(uploaded_before))
        if status:
            docs = docs.join(latest_jobs(self.raw("processing_jobs")).where(F.col("status") == status).select(F.col("document_id").alias("id")), "id", "left_semi")
        if currency:
            of = lambda t: self.raw(t).where(F.col("currency") == currency).select(F.col("document_id").alias("id"))
            docs = docs.join(of("bank_statements").unionByName(of("invoices")), "id", "left_semi")
        return page(docs, limit, offset, after)

    def soft_delete(self, document_id: str, at) -> None:
        found = self.get_document(document_id).select(F.col("id").alias("document_id"), F.lit(at).cast("timestamp").alias("deleted_at"))
        self.append("deletions", found, f"delete-{document_id}")
        self.commit(f"delete-{document_id}")

    def soft_delete_all(self, documents: DataFrame, at, batch: str) -> None:
        """Deletes many documents (column id) at once."""
        live = self.table("documents").where("not is_deleted").join(documents.select("id").distinct(), "id", "left_semi")
        self.append("deletions", live.select(F.col("id").alias("document_id"), F.lit(at).cast("timestamp").alias("deleted_at")), batch)
        self.commit(batch)

    def documents_with_results(self) -> DataFrame:
        return with_results(self.table("documents").where("not is_deleted"), self.raw("bank_statements"), self.raw("invoices"))

    def statement_with_transactions(self) -> DataFrame:
        return nested(self.raw("bank_statements"), self.raw("bank_transactions").drop("id"), "bank_statement_id", "row_index", "transactions")

    def invoice_with_lines(self) -> DataFrame:
        return nested(self.raw("invoices"), self.raw("invoice_line_items").drop("id"), "invoice_id", "line_number", "line_items")

    def job_states(self) -> DataFrame:
        """Where every job stands, also of batches that are at work or broke off."""
        return job_states(self.raw("job_events"))

    # --- ingest

    def ingest(self, files: DataFrame, batch: str, at, allow_reprocess: bool = False, uploaded_by: str = "system", texts: DataFrame | None = None, max_retries: int = 0) -> DataFrame:
        """Takes files (file_id, original_name, length, content, uploaded_at) in, and returns them with their
        document_id, status and error_code.  ``texts``: (file_id, text, tables, page_texts) of PDF files, from
        whatever extractor is at hand, and what else it says of them (any columns of ``EXTRACTED``); without it a PDF
        has no text.  Run again, a batch gives the same ids.

        Contents are written once, beside what each file says of itself; whatever decides between files reads the rest
        of these columns alone, and parsing reads contents where they lie.  An attempt that fails leaves a ``failed`` event of every job and is
        made again up to ``max_retries`` times.
        """
        self.uncommit(batch)
        now = F.lit(at).cast("timestamp")
        answers = None if texts is None else self._answers(texts)
        encoding = F.when(F.col("extension") == ".csv", Files.encoding_of(F.col("content"))).when(F.col("extension") == ".xlsx", "utf-8")
        self.append("_files", described(files, self.limits).withColumn("encoding", encoding), batch)
        held = self._read("_files", [batch]).drop("_batch")
        before = self.table("documents").where(F.col("storage_path").isNull() | ~F.col("storage_path").contains(f"/batch={batch}#"))
        checked = judged(held, before, allow_reprocess, answers, limits=self.limits)
        checked = checked.withColumn("document_id", F.coalesce("reprocess_of", make_id(F.lit("document"), "checksum_sha256", F.lit(batch)))).withColumn("job_id", make_id("document_id", F.lit(batch)))
        path = f"{self.root}/_checked/batch={batch}"
        checked.write.mode("overwrite").parquet(path)
        checked = self.spark.read.schema(checked.schema).parquet(path)
        good = checked.where("error_code is null")
        if good.isEmpty():  # nothing to parse, and no jobs to tell of
            self.commit(batch)
        for attempt in range(1, max_retries + 2) if batch in self._written else ():
            self._tell(good, batch, attempt, now, ("pending", "processing") if attempt == 1 else ("processing",))
            try:
                self._run(held, good, batch, now, attempt, max_retries, uploaded_by, texts)
                break
            except Exception as e:
                self._tell(good, batch, attempt, now, ("failed",), str(e).split("\n")[0][:500])
                if attempt > max_retries:
                    raise
        ran = self.raw("processing_jobs").select(F.col("id").alias("job_id"), "status", "error_message")
        return checked.join(ran, "job_id", "left").withColumn("error_code", F.coalesce("error_code", "error_message")).select("file_id", "original_name", F.when(F.col("status").isNotNull(), F.col("document_id")).alias("document_id"), "status", "error_code")

    def _tell(self, good: DataFrame, batch: str, attempt: int, now: Column, states: tuple[str, ...], message: str | None = None) -> None:
        """Events of all jobs of a batch, visible at once though the batch is not."""
        name = f"{batch}--events-{attempt}-{states[-1]}"
        events = good.select("job_id", "document_id", F.explode(F.array(*map(F.lit, states))).alias("state"), F.lit(attempt).alias("attempt"), now.alias("at"), F.lit(message).alias("message"))
        self.append("job_events", events, name)
        self.commit(name)

    def _run(self, held: DataFrame, good: DataFrame, batch: str, now: Column, attempt: int, max_retries: int, uploaded_by: str, texts: DataFrame | None) -> None:
        """One attempt: documents, what is parsed of them, jobs, and the batch's entry at the end."""
        document_type = F.when(F.col("extension") == ".pdf", "invoice").otherwise("bank_statement")
        self.append("documents", good.where("reprocess_of is null").select(
            F.col("document_id").alias("id"), "filename", "original_name", document_type.alias("document_type"), F.expr("substring(extension, 2)").alias("file_type"), F.col("length").alias("file_size_bytes"),
            "checksum_sha256", F.concat(F.lit(f"{self.root}/_files/batch={batch}#"), "file_id").alias("storage_path"), F.lit(uploaded_by).alias("uploaded_by"), now.alias("uploaded_at"), now.alias("created_at"), now.alias("updated_at"),
        ), batch)
        kinds = {r["extension"] for r in good.select("extension").distinct().collect()}
        done = self.spark.createDataFrame([], f"file_id string, failure string, detail map<string,string>, warnings {S.WARNING}, scanned_pages array<int>")
        if kinds - {".pdf"}:
            done = done.unionByName(self._statements(held, good, batch, now))
        if ".pdf" in kinds:
            done = done.unionByName(self._invoices(good, batch, now, texts))
        said = {"pdf_password_used": F.lit(False), "pdf_encryption_type": F.lit(None).cast("string")}
        said |= {c: F.coalesce(F.col(c), other) for c, other in said.items() if c in good.columns}
        jobs = good.join(done, "file_id", "left").select(
            F.col("job_id").alias("id"), "document_id", F.lit(attempt).alias("attempt"), S.job_status(F.col("failure"), F.col("warnings")).alias("status"), now.alias("started_at"), now.alias("completed_at"), F.col("failure").alias("error_message"), F.col("detail").alias("error_detail"),
            F.lit(attempt - 1).alias("retry_count"), F.lit(max_retries).alias("max_retries"), "warnings", F.when(F.col("extension") == ".pdf", PDF_VERSION).otherwise(CSV_VERSION).alias("parser_version"),
            F.col("reprocess_of").isNotNull().alias("is_reprocess"), *[c.alias(k) for k, c in said.items()], F.lit(False).alias("ocr_used"), "scanned_pages", now.alias("created_at"), now.alias("updated_at"),
        )
        self.append("processing_jobs", jobs, batch)
        ended = self._read("processing_jobs", [batch])
        self.append("job_events", ended.select(F.col("id").alias("job_id"), "document_id", F.col("status").alias("state"), "attempt", F.col("completed_at").alias("at"), F.col("error_message").alias("message")), batch)
        self.commit(batch)
        for name in ("_grid", "_parsed", "_statements", "_invoices"):
            self._remove(f"{self.root}/{name}/batch={batch}")

    def _answers(self, texts: DataFrame) -> DataFrame:
        """What an extractor says of PDF files, with what it leaves out filled in."""
        wanted = {c.split()[0]: c.split()[1] for c in EXTRACTED.split(", ")}
        given = texts.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in texts.columns})
        given = given.select(*[F.col(c).cast(kind).alias(c) for c, kind in wanted.items()], F.size("page_texts").alias("_pages"))
        return given.withColumns({"opened": F.coalesce("opened", F.lit(True)), "page_count": F.coalesce("page_count", "_pages")}).drop("_pages")

    def _statements(self, held: DataFrame, good: DataFrame, batch: str, now: Column) -> DataFrame:
        # Contents are decoded where they lie; that a file is a duplicate shows when its rows meet the files below.
        may = held.where("early is null and late is null")
        plain = may.where("extension = '.csv'").select("file_id", Files.decoded(F.col("content"))["text"].alias("text"))
        texts = plain.unionByName(Files.xlsx_text(may.where("extension = '.xlsx'")).select("file_id", "text"))
        grid_path = f"{self.root}/_grid/batch={batch}"
        Files.tokenise(texts).write.option("maxRecordsPerFile", GRID_RECORDS).mode("overwrite").parquet(grid_path)  # Python runs once, whatever reads the grid
        ids = good.where("extension <> '.pdf'").select("file_id", "document_id", "job_id", "encoding", make_id(F.lit("statement"), "job_id").alias("statement_id"))

        def stage(rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{self.root}/_parsed/batch={batch}")
            return self.spark.read.schema(rows.schema).parquet(f"{self.root}/_parsed/batch={batch}")

        found = S.parse(self.spark.read.schema(Files.GRID).parquet(grid_path), ids, self.limits, self.rules, stage=stage)
        path = f"{self.root}/_statements/batch={batch}"
        found.statements.join(ids.drop("encoding"), "file_id").write.mode("overwrite").parquet(path)
        summaries = self.spark.read.parquet(path)
        kept = summaries.where("error_code is null")
        self.append("bank_statements", kept.withColumns({"id": F.col("statement_id"), "processing_job_id": F.col("job_id"), "extracted_at": now, "updated_at": now}), batch)
        transactions = found.transactions.join(kept.select("file_id", F.col("statement_id").alias("bank_statement_id")), "file_id")
        self.append("bank_transactions", transactions.withColumns({"id": make_id("bank_statement_id", F.col("row_index").cast("string")), "created_at": now}), batch)
        return summaries.select("file_id", F.col("error_code").alias("failure"), F.when(F.size("missing") > 0, F.create_map(F.lit("missing_columns"), F.array_join("missing", ", "))).alias("detail"), "warnings", F.lit(None).cast("array<int>").alias("scanned_pages"))

    def _invoices(self, good: DataFrame, batch: str, now: Column, texts: DataFrame | None) -> DataFrame:
        pdfs = good.where("extension = '.pdf'").select("file_id", "document_id", "job_id")
        if texts is None:
            texts = pdfs.select("file_id", F.lit("").alias("text"), F.expr(f"cast(array() as {I.TABLES})").alias("tables"), F.array(F.lit("")).alias("page_texts"))
        docs = pdfs.join(texts, "file_id").withColumn("scanned", scanned_pages(F.col("page_texts"), self.limits))
        docs = docs.withColumn("failure", F.when(F.size("scanned") > 0, "OCR_FAILED"))
        invoices, lines = I.parse(docs.where("failure is null").select("file_id", "text", "tables"), self.rules, self.limits)
        path = f"{self.root}/_invoices/batch={batch}"
        invoices.join(pdfs, "file_id").write.mode("overwrite").parquet(path)
        parsed = self.spark.read.parquet(path).withColumn("id", make_id(F.lit("invoice"), "job_id"))
        vendors = merged_vendors(self.raw("vendors", batch))
        known, new = resolve_vendors(parsed.select(F.col("raw_vendor_name").alias("name")).distinct(), vendors)
        # A spelling that a known vendor did not have yet is a row of its own, which the merged view adds to its names.
        spelt = known.groupBy("vendor_id").agg(F.array_sort(F.collect_set("name")).alias("_more")).join(vendors.withColumnRenamed("id", "vendor_id"), "vendor_id")
        spelt = spelt.where(F.size(F.array_except("_more", "raw_names")) > 0).select(F.col("vendor_id").alias("id"), "canonical_name", F.col("_more").alias("raw_names"))
        self.append("vendors", new.unionByName(spelt).withColumns({"created_at": now, "updated_at": now}), batch)
        vendors = merged_vendors(self.raw("vendors", but=batch, within=batch)).groupBy(F.lower("canonical_name").alias("_key")).agg(F.min_by("id", "canonical_name").alias("vendor_id"))
        parsed = parsed.join(vendors, F.lower("raw_vendor_name") == F.col("_key"), "left")
        self.append("invoices", parsed.withColumns({"processing_job_id": F.col("job_id"), "invoice_index": F.lit(0), "extracted_at": now, "updated_at": now}), batch)
        owned = lines.join(parsed.select("file_id", F.col("id").alias("invoice_id")), "file_id")
        self.append("invoice_line_items", owned.withColumns({"id": make_id("invoice_id", F.col("line_number").cast("string")), "created_at": now}), batch)
        ok = parsed.select("file_id", F.col("error_code").alias("failure"), F.lit(None).cast("map<string,string>").alias("detail"), F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("field"), w.alias("message"))).alias("warnings"), F.expr("cast(array() as array<int>)").alias("scanned_pages"))
        failed = docs.where("failure is not null").select("file_id", "failure", F.create_map(F.lit("page_count"), F.size("page_texts").cast("string")).alias("detail"), F.expr(f"cast(array() as {S.WARNING})").alias("warnings"), F.col("scanned").alias("scanned_pages"))
        return ok.unionByName(failed)
