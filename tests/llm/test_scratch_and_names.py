"""Who owns scratch tables, stages chained without writing, and columns that bear the operators' own names."""

import os
import threading
from collections import Counter

import pytest

from ledgermill.llm import entries, fim, linededup, mixing, quality, sharding, simhash, toxicity, urls
from ledgermill.llm.common import Scratch, consumed, fresh, row_keys, shared_dir


def tables(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if "-" in f}


def test_stages_chained_without_writing(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lazy, scratch = docs, Scratch(spark, "t")
    written = docs
    for name, stage in c.STAGES[:4]:
        lazy, written = stage(spark, lazy, sf_dir), scratch.cut(stage(spark, written, sf_dir))
    count = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert count(lazy) == count(written)


def test_run_leaves_its_result_alone(spark, sf_dir, monkeypatch):
    import corpus_pipeline as c

    before = tables(spark)
    found = c.run(spark, sf_dir)
    assert found.count() > 0
    left = tables(spark) - before
    assert len(left) == 1 and len(os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{left.pop()}")) == 1

    def broken(spark, docs, sf_dir):
        raise RuntimeError("broken")

    before = tables(spark)
    monkeypatch.setattr(c, "STAGES", [*c.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError, match="broken"):
        c.run(spark, sf_dir)
    assert tables(spark) == before


def test_two_threads(spark):
    """Neither removes what the other still reads."""
    df = spark.range(100)
    made, wait, go = {}, threading.Event(), threading.Event()

    def first():
        with consumed():
            made["one"] = Scratch(spark, "one").cut(df)
            wait.set()
            go.wait(60)
            made["n"] = made["one"].count()

    def second():
        wait.wait(60)
        with consumed():
            made["two"] = Scratch(spark, "two").cut(df)
        go.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made["n"] == 100
    for name in ("one", "two"):
        with pytest.raises(Exception, match="(?i)exist"):
            made[name].count()


def test_settle_keeps_one_table(spark):
    scratch = Scratch(spark, "t")
    a = scratch.cut(spark.range(5))
    b = scratch.settle(a.withColumn("x", a.id))
    assert b.count() == 5 and os.listdir(scratch.root.removeprefix("file:")) == ["2"]


def test_row_keys_tell_nulls_from_values(spark):
    df = spark.createDataFrame([(None, "x", {"a": 1}), ("x", None, {"a": 1}), ("x", None, None), (None, None, None)], "a string, b string, m map<string,int>")
    assert df.select(*row_keys(df)).distinct().count() == 3
    assert fresh(df, "A", "z", "z") == ["A_", "z", "z_"]


#: Names that the operators use inside.
INNER = ["_d", "_t", "_covers", "_kept", "_id", "_null", "_hash", "_rule", "_mine", "_words", "_lines", "_text", "_k1", "_k2", "_whole", "_part", "_is_whole",
         "_key", "_mix_id", "_r_d", "_r__d", "h1", "h2", "fp", "group", "component_id", "row", "g", "r", "d", "bucket", "placed", "n", "key", "first", "a.b"]


def test_columns_that_bear_inner_names(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "source")
    docs = docs.select("*", *[docs.source.alias(c) for c in INNER])
    plain = odd_docs.select("doc_id", "text", "source")
    rows = lambda df, *cols: Counter(tuple(map(str, r)) for r in df.select(*cols).collect())
    model = toxicity.train(plain, plain.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic").where("doc_id is not null").dropDuplicates(["doc_id"]))
    rules = spark.createDataFrame(entries.URL_RULES, "host string, path string, action string")
    paged = lambda df: df.withColumn("url", df.text)
    for op, out in (
        (linededup.dedup, ["doc_id", "text", "n_lines", "n_removed"]),
        (simhash.keep_one, ["doc_id", "text"]),
        (mixing.apply, ["doc_id", "text"]),
        (quality.judge, ["doc_id", "text", "n_words", "kept"]),
        (lambda df: toxicity.score(df, model), ["doc_id", "text", "score"]),
        (lambda df: urls.judge(paged(df), rules), ["doc_id", "host", "path", "rule", "verdict"]),
        (fim.transform, ["doc_id", "text", "fim"]),
        (sharding.shard, ["doc_id", "text", "size", "shard", "slot"]),
    ):
        found = op(docs)
        assert set(INNER) <= set(found.columns), op
        assert rows(found, *out) == rows(op(plain), *out), op
        inner = [f"`{c}`" for c in INNER]
        assert all(len(set(r)) == 1 for r in found.select("source", *inner).toDF(*[f"c{i}" for i in range(len(INNER) + 1)]).collect()), op


def test_many_shapes_of_rules(spark):
    """Hundreds of label counts and path lengths are two arrays in the plan, and hosts beyond ASCII are compared as they are."""
    rules = [(f"h{i}.{'x.' * (i % 4)}example.net", "/" + "p" * (i % 150) + "/", "block" if i % 2 else "allow") for i in range(1200)] + [("Éa.net", "/", "block"), ("éb.NET", "/", "block")]
    pages = [(i, f"http://w.{h}{p}q" if i % 3 else f"http://{h}{p[:-2]}") for i, (h, p, _) in enumerate(rules[::5])] + [(900, "http://Éa.net/"), (901, "http://éa.net/"), (902, "http://éb.net/x")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    low = lambda h: "".join(c.lower() if c < "\x80" else c for c in h)
    for i, u in pages:
        host, slash, tail = u.split("://")[1].partition("/")
        host, path = low(host), slash + tail
        fits = [(len(low(h) + p), low(h) + p, a) for h, p, a in rules if (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == best[1:], u
