"""Token counts of documents in flat token files that have no index.

A token file is the documents' ids as little-endian numbers, each document followed by an end-of-document id, and
nothing else.  It is read in blocks of a fixed number of tokens that know nothing of documents: a task opens the file
in the store that the cluster shares, at the block's place, so files of any size are read in parallel and no task holds
more than a block.  Each block is searched for the identifier with vectorised comparisons; a prefix scan over the
blocks' summaries (separators so far, and the last separator's place) then gives every block the number of its first
document and where that began, so documents that cross blocks are stitched without reading a token twice.

``write`` makes such files, one per partition.  A task that runs again writes another file, and only files of tasks
that ended are listed.  Files are opened with pyarrow, which knows local and mounted folders and the usual object
stores.

Defined results: two identifiers in a row are a document of 0 tokens; tokens after a file's last identifier
are a document of their own; an empty file has none; a null or empty text is a document of 0 tokens; repeated
rows are documents of their own; an identifier that the vocabulary uses is refused, as is a file that ends inside a
token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .bpe import _texts_in_parts, vocabulary
from .common import Scratch, lean, opened, running, ship

#: Tokens of a block.
BLOCK = 1 << 18
#: Blocks that a task scans one after another, and tasks at most.
BLOCKS_A_TASK, MAX_TASKS = 32, 20_000
#: Blocks that share a bucket of the prefix scan.
PER_BUCKET = 1024


def write(df: DataFrame, scratch: Scratch, path: str, pattern: str, eod: int, text: str = "text", doc_id: str = "doc_id",
          dtype: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Encodes the texts into token files, one per partition of the input.  Returns the files (file, path, length)
    and who is who (file, ordinal, doc_id)."""
    kind, root = df.schema[doc_id].dataType, f"{scratch.root}/tokens"
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("file", T.LongType()), T.StructField("at", T.LongType()), T.StructField("doc_id", kind), T.StructField("path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, file = vocabulary(path, pattern), TaskContext.get().partitionId()
        if eod in vocab.bytes_of:
            raise ValueError(f"{eod} is a token of the vocabulary")
        end = np.int32(eod).tobytes()
        store, folder = opened(root)
        store.create_dir(folder, recursive=True)
        name, n_docs, size, ids_type = f"{file}-{uuid.uuid4().hex}.bin", 0, 0, pa.null()

        def rows(part: str, at: list, ids: pa.Array, where: str | None) -> pa.RecordBatch:
            n = len(at)
            return pa.RecordBatch.from_arrays([pa.array([part] * n), pa.array([file] * n, pa.int64()), pa.array(at, pa.int64()), ids, pa.array([where] * n, pa.string())], names=schema.names)

        with lean(vocab.memory, vocab.older), store.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for part in _texts_in_parts(batch):
                    own: list[bytes] = []
                    for stretches in vocab.encode_batch(part.column("_text").to_pylist()):
                        own += [ids for ids, _, _ in stretches]
                        own.append(end)
                    ids = np.frombuffer(b"".join(own), np.int32)
                    if len(ids) and ids.max() > np.iinfo(dtype).max:
                        raise ValueError(f"a token of {ids.max()} does not fit {dtype}")
                    data = ids.astype(dtype).tobytes()
                    out.write(data)
                    size, ids_type = size + len(data), part.column(0).type
                    yield rows("documents", list(range(n_docs, n_docs + len(part))), part.column(0), None)
                    n_docs += len(part)
        if n_docs:
            yield rows("files", [size], pa.nulls(1, ids_type), f"{root}/{name}")

    ship(df.sparkSession)
    written = scratch.cut(df.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema), partition_by="part")
    files = written.where("part = 'files'").select("file", "path", F.col("at").alias("length"))
    return files, written.where("part = 'documents'").select("file", F.col("at").alias("ordinal"), "doc_id")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder (file, path, length); ``file`` is the path.  Spark lists them and reads none."""
    found = spark.read.format("binaryFile").load(path).where("length > 0")
    return found.select(F.col("path").alias("file"), "path", "length")


def count(files: DataFrame, eod: int, scratch: Scratch, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, in the order in which a file holds them."""
    schema = T.StructType([files.schema["file"], T.StructField("block", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n", "seps", "first", "last")], T.StructField("inner", T.ArrayType(T.IntegerType()))])
    width = np.dtype(dtype).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seps, first, last, inner = [], [], [], [], []
            for at, path, length in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True):
                if length % width:
                    raise ValueError(f"{path} ends inside a token")
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(block * width, length - at * block * width), at * block * width), dtype)
                places = np.flatnonzero(ids == eod)
                n.append(len(ids))
                seps.append(len(places))
                first.append(at * block + int(places[0]) if len(places) else None)
                last.append(at * block + int(places[-1]) if len(places) else None)
                inner.append((np.diff(places) - 1).astype(np.int32))
            columns = [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (n, seps, first, last)], pa.array(inner, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ship(files.sparkSession)
    last_block = F.expr(f"(length - 1) div {block * width}")
    blocks = files.where("length > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"), "path", "length")
    # A block's row is small and its work is not, so the number of tasks is set: BLOCKS_A_TASK blocks each, MAX_TASKS at most.
    many = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // (block * width * BLOCKS_A_TASK) + 1
    scanned = scratch.cut(blocks.repartition(min(MAX_TASKS, many), "path", "block").mapInArrow(scan, schema))
    scanned = scanned.withColumn("bucket", F.expr(f"block div {PER_BUCKET}"))
    before = running(scanned, ["file"], "bucket", [("seps", "seps0", "sum"), ("last", "last0", "max")])
    within = W.partitionBy("file", "bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = scanned.join(before, ["file", "bucket"]).withColumns({
        "ordinal": F.col("seps0") + F.coalesce(F.sum("seps").over(within), F.lit(0)),
        "open": F.coalesce(F.greatest(F.max("last").over(within), F.col("last0")), F.lit(-1)),
    })
    lengths = F.concat(F.array((F.col("first") - F.col("open") - 1).cast("long")), F.col("inner").cast("array<long>"))
    closed = placed.where("seps > 0").select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")
    ends = scanned.groupBy("file").agg(F.sum("seps").alias("ordinal"), F.sum("n").alias("n"), F.max("last").alias("last"))
    tail = ends.withColumn("n_tokens", F.col("n") - F.coalesce("last", F.lit(-1)) - 1).where("n_tokens > 0")
    return closed.unionByName(tail.select("file", "ordinal", "n_tokens"))
