"""The corpus pipeline: from raw documents to the token ids of a training mix.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs; all but the last return the columns of
``documents``.  A stage's result is lazy and reads its docs and at most one table of keys that the stage has left
in the shared folder, so stages may also be chained without writing between them.  Whoever writes a result inside
``consumed()``, as ``run`` does, leaves no such table behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermill.llm import bpe, linededup, mixing, simhash, toxicity
from ledgermill.llm.common import WORD, Scratch, consumed, table

#: Scores from which a document is rejected.
TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go.  It never learns from held-out labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    with consumed():  # the model is broadcast; the tables of its training have served
        model = toxicity.train(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).drop("score")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines inside repeated windows go, and documents of which no line with a word is left by that."""
    found = linededup.dedup(docs)
    found = found.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return found.drop("n_lines", "n_removed").withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, overlap of 0.8 or more) stays."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, with documents repeated as the mix takes them."""
    return mixing.apply(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True).drop("ids_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL has no XXH64 of shingles and no byte-pair merges; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            with consumed():
                before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
            if k:
                scratch.drop(before)
    except BaseException:
        scratch.remove()
        raise
    return docs
