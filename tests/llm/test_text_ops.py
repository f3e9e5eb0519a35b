"""Url filters, BPE, mixing, SimHash and quality rules against brute force."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from ledgermill.llm import bpe, entries, mixing, quality, simhash, urls


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- urls

def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter(spark):
    hosts = ["net", "a.net", "example.net", "X.Example.NET", "xexample.net", "example.com", "m.example.com", "b.org", "org", "", "net.", "a.net:80", ".net"]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/de/", "/de/a#b", "/fr/", "?q", "#f", "/EN/", "//"]
    found = [None, "", "nothing", "http:/x.net/", "a://b://net/"] + [f"http://{h}{p}" for h in hosts for p in paths]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(found * 2)], "page_id long, url string, `rule` string")
    rules = [*entries.URL_RULES, ("example.com", "/de/a", "allow"), (None, "/", "block")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urls.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")))}
    assert got == {i: brute_url(u, rules[:-1]) for i, u in enumerate(found * 2)}


def test_url_filter_empty(spark):
    rules = spark.createDataFrame(list(entries.URL_RULES), "host string, path string, action string")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert [r["verdict"] for r in rows(urls.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), rules.limit(0)))] == ["allow"]


def test_url_filter_in_parts(spark, monkeypatch):
    """A list over the bound is judged in parts, with the same verdicts."""
    rules = [(f"h{i % 40}.x{'y' * (i % 3)}.net" if i % 2 else f"x{'y' * (i % 3)}.net", f"/{'p' * (i % 5)}{'/' if i % 5 else ''}", "block" if i % 3 else "allow") for i in range(300)]
    found = [f"http://{h}{p}" for h in ("a.h7.xy.net", "h7.xy.net", "xyy.net", "h9.x.net", "z.net", "x.net") for p in ("/", "/p/", "/ppp/a", "/pppp/?x", "")]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    table = spark.createDataFrame(list(dict.fromkeys(rules)), "host string, path string, action string")
    want = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(urls.judge(pages, table))}
    assert len({v for _, v in want.values()}) == 2
    block = {h + p for h, p, a in rules if a == "block"}
    for i, u in enumerate(found):
        _, _, rule, verdict = brute_url(u, [(h, p, a) for h, p, a in rules])
        assert want[i] == (rule, "block" if rule in block else verdict)
    monkeypatch.setattr(urls, "MAX_FILTER_BYTES", 100)
    assert urls.parts(300, 1000) > 2
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(urls.judge(pages, table))} == want


def test_cascade_is_exact(spark):
    from ledgermill.llm.common import Scratch

    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    cascade = urls.build(spark.range(0, 5000, 7).selectExpr("concat('k', id) as key"), universe, Scratch(spark, "t"))
    assert len(cascade.levels) > 1 and len(cascade.named) <= urls.FEW
    assert universe.where(cascade.contains(universe.key) != (universe.key.substr(2, 9).cast("int") % 7 == 0)).count() == 0


# --- BPE

PATH = P.path("byte_bpe_50k.tiktoken")


def test_bpe(odd_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in odd_docs.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(odd_docs, PATH, P.PATTERN).collect()) == want
    ids = bpe.encode(odd_docs, PATH, P.PATTERN, carry=("doc_id", "text"))
    back = bpe.decode(ids, PATH, P.PATTERN, carry=("doc_id", "text")).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)


@pytest.mark.parametrize("text", ["  two  spaces ", "a\u00a0 b", "tab\t x", "\0nul \0", " x", "x ", "'s 't've", "12 345abc...", "aaaa" * 200, "é" * 300, "\x1c \x1c a"])
def test_bpe_pieces(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocab = bpe.vocabulary(PATH, P.PATTERN)
    assert vocab.encode(text) == own.encode_ordinary(text)
    assert vocab.decode(vocab.encode(text)) == text.encode()


def test_bpe_other_pattern():
    """A pattern in whose matches spaces stand inside."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"[a-z]+ [a-z]+|\s+|\S+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("of the of the x y", "a b c d", " a b", "one two three"):
        assert bpe.vocabulary(PATH, pattern).encode(text) == own.encode_ordinary(text)


def test_bpe_heap_equals_matrix(monkeypatch):
    import random

    r, vocab = random.Random(2), bpe.vocabulary(PATH, P.PATTERN)
    pieces = [bytes(r.choices(b"abeinrst\xc3\xa9", k=n)) for n in (2, 3, 17, 257, 1500, 4097, 5000)] + [b"a" * 4500, b"ab" * 2100]
    by_heap = vocab.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "MATRIX_BYTES", 1 << 20)
    assert vocab.encode_pieces(pieces) == by_heap


def test_bpe_empty(odd_docs):
    assert bpe.round_trip(odd_docs.limit(0), PATH, P.PATTERN).count() == 0


# --- mixing

def brute_targets(totals, weights=(3, 1, 2), budget=1.5, epochs=2.0):
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = budget * sum(totals.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * totals[s]}
        for s in over or free:
            target[s] = epochs * totals[s] if over else level * weight[s]
        left -= sum(epochs * totals[s] for s in over)
        free = free - over if over else set()
    return target


@pytest.mark.parametrize("block", [3, 256])
def test_mixing(odd_docs, block):
    sizes = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd_docs.collect()]
    totals = Counter()
    for _, s, n in sizes:
        totals[s] += n
    want = brute_targets(totals)
    mixed = mixing.mix(odd_docs, block=block)
    got = rows(mixed.documents)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == totals[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-9) for s in totals)
    again = rows(mixing.mix(odd_docs.repartition(7), block=block).documents)
    assert Counter(tuple(r.values()) for r in again) == Counter(tuple(r.values()) for r in got)
    # The schedule is even: every prefix of slots is near the target shares.
    slots = sorted({(r["slot"], r["source"]) for r in rows(mixed.schedule)}, key=lambda x: x[0])
    if block == 3:
        seen = Counter()
        for k, (_, s) in enumerate(slots[: len(slots) // 2], 1):
            seen[s] += 1
            assert all(abs(seen[x] - k * want[x] / sum(want.values())) < 6 for x in totals)


def test_mixing_empty(odd_docs):
    assert mixing.mix(odd_docs.limit(0)).documents.count() == 0
    assert [r["taken"] for r in rows(mixing.mix(odd_docs.where("text is null")).documents)] == [0, 0]


# --- SimHash

def brute_simhash(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius):
    label = list(range(len(fps)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(odd_docs):
    docs = odd_docs.collect()
    fps = [brute_simhash(r["text"]) for r in docs]
    group = brute_groups(fps, 4)
    want = Counter((r["doc_id"], f, min((docs[j]["doc_id"] for j in range(len(docs)) if group[j] == g and docs[j]["doc_id"] is not None), default=None)) for r, f, g in zip(docs, fps, group, strict=True))
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in rows(simhash.groups(odd_docs)))
    assert got == want
    assert simhash.groups(odd_docs.limit(0)).count() == 0


def test_simhash_large_bucket(spark, monkeypatch):
    """A chain and a ball of near fingerprints, in buckets of many tiles."""
    import random

    from ledgermill.llm.common import Scratch
    from ledgermill.llm.components import connected

    monkeypatch.setattr(simhash, "TILE", 16)
    r = random.Random(3)
    ball = {0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(400)}
    ball |= {r.getrandbits(64) for _ in range(50)}
    fps = sorted(ball)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark, "t")
    roots = dict(connected(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, scratch), scratch).collect())
    group = brute_groups(fps, 4)
    for i in range(len(fps)):
        members = [signed[j] for j in range(len(fps)) if group[j] == group[i]]
        assert roots.get(signed[i], signed[i]) == min(members)


def test_covering_masks():
    import random

    r, found = random.Random(1), [m & (2**64 - 1) for m in simhash.masks(4)]
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), 4))
        assert any(m & diff == 0 for m in found)


# --- quality

def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(odd_docs):
    want = Counter((r["doc_id"], *brute_quality(r["text"])) for r in odd_docs.collect())
    judged = quality.judge(odd_docs)
    got = Counter(tuple(r) for r in judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == want
    assert judged.where("kept and n_words < 50").count() == 0
    assert quality.judge(odd_docs.limit(0)).count() == 0


def test_repeats_in_a_text_of_millions_of_words(spark):
    """Over 2^20 words; a quarter of them stand outside of repeated windows."""
    n = 840_000
    text = " ".join([w for i in range(n) for w in (f"a{i % 400000}", f"b{i % 400000}", "c", f"u{i}")])
    got = quality.with_metrics(spark.createDataFrame([(text,)], "text string")).first()["n_repeat_words"]
    assert got == brute_quality(text)[4] == 3 * n


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rows(quality.judge(docs).join(labels.select("doc_id", "quality"), "doc_id").where("n_words >= 50"))
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.97


def test_what_batches_share_is_encoded_once(monkeypatch):
    """A memory that overflows at every batch still knows what the batch before used; ids, decimals and bytes agree."""
    vocab = bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 6)
    asked, encode = [], vocab.encode_pieces
    monkeypatch.setattr(vocab, "encode_pieces", lambda pieces: (asked.extend(pieces), encode(pieces))[1])
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    for i in range(12):
        text = f"unthinkably déjà-vu don't unthinkably ab{'xyz' * i} {'q' * i}7 ıſ"
        (stretches,) = vocab.encode_batch([text])
        ids = own.encode_ordinary(text)
        assert np.frombuffer(b"".join([x for x, _, _ in stretches]), np.int32).tolist() == ids
        assert " ".join([x for _, x, _ in stretches]) == " ".join(map(str, ids)) and b"".join([x for _, _, x in stretches]) == text.encode()
    assert asked.count(b" unthinkably") == 1 and asked.count(b"unthinkably") == 1
