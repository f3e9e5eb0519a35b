"""Registered queries of the subpackage: each applies an operator to its whole table with production
parameters and derives the contract's columns from the operator's outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, embeddings, fim, linededup, mixing, oracles, pii, quality, sharding, simhash, spelling, tokencount, toxicity, urls
from .common import Scratch, null_safe, table


#: Rules of the url filter: host, path, action.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, action)")
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken")


#: The vocabulary's free id, used as the end-of-document identifier of token files.
END_OF_DOCUMENT = 50256


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokencount")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    files, who = tokencount.write(table(spark, sf_dir, "documents"), scratch, path, public_tokenizers.PATTERN, END_OF_DOCUMENT)
    counted = tokencount.count(files, END_OF_DOCUMENT, scratch)
    return counted.join(who, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", base_failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("kept")).alias("kept"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.groups(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, percent=90, spm_percent=20)
    output, form = F.col("fim.output"), F.col("fim.form")
    digests = [F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, form), 256).alias("restored_sha256")]
    return cut.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    found = sharding.shard(docs, shards=8, keep=["doc_id", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents").select("doc_id", "text"), ratio=2, shortest=5, least=3, noise=97)


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op12: sizes, that a text's copies share a shard, that slots have no gaps, and that no shard
    has more than an eighth of all bytes and one group."""
    found = op12_sharding(spark, sf_dir)
    texts = found.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("shards_of_text"), F.sum("size").alias("group_size"))
    shards = found.groupBy("shard").agg(
        F.sum("size").alias("bytes"), ((F.count(F.lit(1)) == F.max("slot") + 1) & (F.count_distinct("slot") == F.count(F.lit(1)))).alias("gapless")
    )
    whole = shards.agg(F.sum("bytes").alias("total")).crossJoin(texts.agg(F.max("group_size").alias("most")))  # one row each
    fair = shards.join(F.broadcast(whole)).select("shard", "gapless", (8 * (F.col("bytes") - F.col("most")) <= F.col("total")).alias("fair"))
    return found.join(texts, ["text_crc32", "size"]).join(F.broadcast(fair), "shard").select("doc_id", "size", "shards_of_text", "gapless", "fair")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: sizes, targets, and what each source gives."""
    mixed = mixing.mix(table(spark, sf_dir, "documents")).documents
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("source_taken"))
    joined = null_safe(mixed, sums, ["source"])
    return joined.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "source_taken", (F.col("taken") <= 2 * F.col("size")).alias("within"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: how many spans each pattern finds."""
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in pii.KINDS])


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    found = dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
    return found | {"mixing_targets": mixing_targets, "pii_counts": pii_counts, "sharding_law": sharding_law}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}
