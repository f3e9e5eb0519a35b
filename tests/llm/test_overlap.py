"""Near-duplicates by shingle overlap against brute-force Jaccard."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from ledgermill.llm import overlap, simhash
from ledgermill.llm.common import Scratch


def brute_overlap(texts, width=5):
    """For each text the smallest index that pairs of Jaccard 0.8 or more lead to."""
    sets = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def agree(df, found):
    docs = df.collect()
    label = brute_overlap([r["text"] for r in docs])
    want = Counter((r["doc_id"], min((d["doc_id"] for d, k in zip(docs, label, strict=True) if k == own and d["doc_id"] is not None), default=None)) for r, own in zip(docs, label, strict=True))
    assert Counter((r["doc_id"], r["component_id"]) for r in found.collect()) == want
    return len(set(label))


@pytest.mark.parametrize("tile", [1024, 4])
def test_overlap(spark, odd_docs, monkeypatch, tile):
    """Random edits around the threshold, one large group and a line that stands in most documents."""
    monkeypatch.setattr(overlap, "TILE", tile)
    r = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = r.choices(words, k=r.randint(5, 150))
        for _ in range(6):
            cut = list(base)
            for _ in range(r.randint(0, 1 + len(cut) // 40)):
                cut[r.randrange(len(cut))] = r.choice(words)
            texts.append(" ".join(cut[: r.randint(len(cut) * 8 // 10, len(cut))]))
    base = r.choices(words, k=120)
    texts += [" ".join([*base[:i], "zz", *base[i + 1 :]]) for i in range(0, 120, 4)]
    texts += ["all of these documents begin with one line " + " ".join(r.choices(words, k=30)) for _ in range(25)]
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    agree(df, overlap.groups(df))
    assert overlap.groups(df.limit(0)).count() == 0


def test_stage_links_real_near_copies(spark):
    """Pairs of 0.8 and more of the test data, most of which fingerprints put more than 4 bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n = agree(docs, simhash.groups(docs, 5))
    assert simhash.keep_one(docs).count() == n < simhash.groups(docs, 5, 4).select("group").distinct().count()


def test_stage_goes_through_simhash(spark, odd_docs, monkeypatch):
    """The pipeline's groups begin with the fingerprints' links; the overlap drops wrong ones and adds missing ones."""
    import corpus_pipeline

    for t in ["", "a b", "A b c d e f g " * 90, "ä ß z"]:
        assert overlap.fingerprint(overlap.sequence(t, 5)) == simhash.fingerprint(t, 5)
    asked, links = [], simhash.links

    def seen(fps, radius, scratch):
        asked.append((radius, {r["fp"] for r in fps.collect()}))
        return links(fps, radius, scratch)

    monkeypatch.setattr(simhash, "links", seen)
    docs = odd_docs.select("doc_id", "text")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert kept.count() == len(set(brute_overlap([r["text"] for r in docs.collect()])))
    assert asked == [(4, {simhash.fingerprint(r["text"] or "", 5) for r in docs.collect()})]
    # Whatever the fingerprints tie, groups are those of the overlap.
    pairs = lambda sets, scratch: scratch.cut(sets.crossJoin(sets.selectExpr("min(sid) as m")).where("sid <> m").selectExpr("m as a", "sid as b"))
    agree(docs, overlap.groups(docs, candidates=pairs))
    agree(docs, overlap.groups(docs, candidates=lambda sets, scratch: pairs(sets, scratch).limit(0)))


def test_long_texts(spark, monkeypatch):
    """Long texts that share a passage are told apart by sketches and not shingle by shingle, and no table of shingles
    is left; those within the threshold are linked, whatever the sizes of their sketches."""
    r = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    passage = r.choices(words, k=300)
    texts = [" ".join(passage + r.choices(words, k=k)) for k in (2300, 2301, 2302)]  # in too few texts to be common
    for n in (1000, 1040, 2040, 2060, 4100):
        base = r.choices(words, k=n)
        for share in (0.97, 0.9, 0.86, 0.83, 0.79, 0.76, 0.5):
            texts.append(" ".join(base[: int(n * share)] + (r.choices(words, k=int(n * (1 - share))) if share == 0.9 else [])))
    fetched, made, sets, init = [], [], overlap._sets, Scratch.__init__

    def seen(df, width, key, text):
        if key == "sid":
            fetched.extend(len(row["text"].split()) for row in df.collect())
        return sets(df, width, key, text)

    monkeypatch.setattr(overlap, "_sets", seen)
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert agree(df, overlap.groups(df)) < len(texts) - 10
    assert fetched and not {2600, 2601, 2602} & set(fetched)
    roots = [Path(re.sub("^file:/+", "/", s.root)) for s in made]
    assert roots and not [f for root in roots for f in root.glob("*/*.parquet") if "x" in spark.read.parquet(str(f)).columns]


def test_wide_sketch():
    """Its distance, folded to equal sizes by halves, is never more than that of the sets."""
    r = np.random.default_rng(3)
    for n in (1025, 2000, 2048, 2049, 5000):
        own = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        assert 2 * n <= 64 * len(overlap.wide(own)) < 4 * n
        for change in (1, n // 10, n // 5):
            other = own[change:] if change % 2 else np.concatenate([own[change:], r.integers(0, 1 << 63, change, dtype=np.uint64)])
            x, y = overlap.wide(own), overlap.wide(np.unique(other))
            if y is None:
                continue
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            assert np.bitwise_count((x ^ y).view("<u8")).sum() <= len(np.setxor1d(own, other))
    assert overlap.wide(own[:1024]) is None
