"""Fill-in-the-middle, sharding and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from ledgermill.llm import fim, sharding, spelling
from ledgermill.llm.common import Scratch


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- fill in the middle

def brute_fim(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("block", "cache"), [(1 << 20, 1 << 24), (97, 600)])
def test_chunk_counts(monkeypatch, block, cache):
    monkeypatch.setattr(fim, "BLOCK", block)
    r = random.Random(1)
    words = ["ab", "Zz", " ", "\n", "é", "😀", "1", "<P", "<", "longerword"]
    texts = ["", "a", "x" * 20_000, "é" * 9_000, "ab " * 4_000] + ["".join(r.choices(words, k=r.randint(1, 900))) for _ in range(60)]
    chunks = fim.Chunks(cache)
    for t in texts + texts:
        starts = [m.start() for m in fim.TOKEN.finditer(t)] + [len(t)]
        counted = fim.Counted(t, chunks)
        assert counted.n == len(starts) - 1 and counted.ends == sorted(set(counted.ends))
        assert [counted.place(k) for k in range(0, len(starts), 7)] == starts[::7]


def test_equal_passages_give_equal_chunks():
    r = random.Random(3)
    passage = "".join(r.choices("abcdefgh \n", k=20_000))
    at = lambda t: {t[a:b] for a, b in zip([0, *fim._ends(t)], fim._ends(t), strict=False)}
    one, two = at("zzz " * 100 + passage), at(passage + " yyy" * 100)
    assert len(one & two) > 0.9 * len(one)


def test_fim(odd_docs):
    extra = odd_docs.sparkSession.createDataFrame([(900 + i, t, None, None, None, 0, None) for i, t in enumerate(["<P", "a<P", "x <S y", "<<S<M", "a <M> b", "<S>", "word " * 60_000])], odd_docs.schema)
    docs = odd_docs.union(extra)
    made = fim.transform(docs.withColumn("fim", docs.text)).select("doc_id", "text", "fim.*")
    want = Counter((r["doc_id"], r["text"], *brute_fim(r["doc_id"], r["text"])) for r in docs.collect())
    assert Counter(tuple(r) for r in made.collect()) == want
    back = made.select("text", fim.restored(made.output, made.form).alias("again"), "form").collect()
    assert all(r["again"] == (r["text"] or "") for r in back) and {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0 and fim.transform(docs).columns == [*docs.columns, "fim"]


# --- sharding

def brute_cuts(sizes, shards):
    """Sizes of the shards: the least capacity by trying all sums, the first cut, and the rest in the same way."""
    if shards == 1:
        return [sum(sizes)]

    def greedy(cap):
        n, held = 1, 0
        for x in sizes:
            if x > cap:
                return False
            n, held = (n + 1, x) if held + x > cap else (n, held + x)
        return n <= shards

    cap = max(sizes, default=0)
    while not greedy(cap):
        cap += 1
    held, k = 0, 0
    while k < len(sizes) and held + sizes[k] <= cap:
        held, k = held + sizes[k], k + 1
    return [held, *brute_cuts(sizes[k:], shards - 1)]


@pytest.mark.parametrize(("first", "more", "large"), [(12, 9, 1024), (2, 3, 1024), (1, 2, 5)])
def test_cuts(spark, monkeypatch, first, more, large):
    for name, value in (("FIRST", first), ("MORE", more), ("LARGE", large)):
        monkeypatch.setattr(sharding, name, value)
    r = random.Random(first)
    for shards, n in ((3, 1), (4, 70), (8, 300)):
        held = {r.randrange(-(1 << 63), 1 << 63): r.choice([1, 5, 9, 40, 40 * n if r.random() < 0.02 else 3]) for _ in range(n)}
        groups = spark.createDataFrame(list(held.items()), "g long, size long").repartition(3)
        placed, firsts = sharding.plan(groups, shards)
        total = sum(held.values())
        big = sorted((g for g, s in held.items() if s * large > total), key=lambda g: (-held[g], g))
        assert [g for g, _ in placed] == big
        order = big + sorted(g for g in held if g not in set(big))
        of = dict(placed)
        for g in order[len(big) :]:
            of[g] = [k for lo, k in firsts if lo <= g][-1]
        assert [of[g] for g in order] == sorted(of[g] for g in order)
        got = Counter()
        for g, k in of.items():
            got[k] += held[g]
        assert [got[k] for k in range(shards)] == brute_cuts([held[g] for g in order], shards)


def check_shards(found, docs, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in found) == Counter((r["doc_id"], r["text"], size(r["text"])) for r in docs)
    of = {}
    for r in found:
        assert of.setdefault(r["text"] or "", r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
    for k in range(shards):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))
    groups, held = Counter(), Counter()
    for r in found:
        groups[r["text"] or ""] += r["size"]
        held[r["shard"]] += r["size"]
    assert shards * (max(held.values()) - max(groups.values())) <= sum(held.values())


def test_sharding(odd_docs):
    for shards in (1, 3, 8):
        found = sharding.shard(odd_docs.withColumn("slot", odd_docs.text), shards)
        assert sorted(found.columns) == sorted([*odd_docs.columns, "size", "shard", "slot"])
        check_shards(rows(found), rows(odd_docs), shards)
    where = lambda df: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows(sharding.shard(df)))
    assert where(odd_docs) == where(odd_docs.repartition(7))
    assert sharding.shard(odd_docs.limit(0)).count() == 0
    check_shards(rows(sharding.shard(odd_docs.where("text is null or text = ''"))), rows(odd_docs.where("text is null or text = ''")), 8)


def test_a_group_of_a_third_and_rows_of_one_id(spark):
    texts = [(i, "copied " * 9) for i in range(400)] + [(None, "nobody's")] * 200 + [(7, "twice")] * 90 + [(1000 + i, f"text {i} " * (i % 7 + 1)) for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = rows(sharding.shard(docs))
    check_shards(found, rows(docs), 8)
    held = Counter()
    for r in found:
        held[r["shard"]] += r["size"]
    rest = sorted(held.values())[:-1]
    assert len(held) == 8 and rest[-1] < 1.2 * rest[0]  # what the great group leaves is shared evenly


# --- spelling variants

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def brute_spelling(docs, noise):
    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % noise else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    found = {}
    for w, k in n.items():
        ns = [v for v in n if near(w, v)]
        best = min(ns, key=lambda v: (-n[v], v), default=None)
        found[w] = (best if best and n[best] >= 2 * k else None, k, len(ns))
    out = set()
    for w, (f, k, m) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, f, root, k, m, n[f] if f else None))
    return out


@pytest.mark.parametrize("long", [64, 6])
def test_spelling(spark, odd_docs, monkeypatch, long):
    monkeypatch.setattr(spelling, "LONG", long)
    r = random.Random(long)
    pool = ["".join(r.choices("abÀ", k=r.randint(4, 8))) for _ in range(120)] + ["colour", "color", "colouur", "collor", "ßtraße", "STRASSE", "Éclairé", "x" * 64, "x" * 65, "x" * 66, "y" + "x" * 64, "x" * 63 + "b", "x" * 65 + "c", "x" * 70 + "de", "x" * 70 + "ce", "x" * 70 + "e"]
    weights = [2 ** r.randint(0, 6) for _ in pool]
    docs = [(i if i % 9 else None, " ".join(r.choices(pool, weights, k=60)) + r.choice(["", "!", "-9", "\n"])) for i in range(150)]
    docs += [(x["doc_id"], x["text"]) for x in rows(odd_docs)] + [(1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 4999)] * 3
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string").repartition(5)
    got = rows(spelling.group(df, noise=5))
    assert {tuple(g[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for g in got} == brute_spelling(docs, 5)
    assert len({g["word"] for g in got}) == len(got) and any(len(g["word"]) >= 4999 and g["n_near"] for g in got)
    assert spelling.group(df.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"word{'a' * i}", f"word{'a' * (i + 1)}") for i in range(12)]
    formed = spark.createDataFrame(chain, "name string, form string")
    assert {r["root"] for r in rows(spelling._roots(formed, Scratch(spark, "t")))} == {"word" + "a" * 12}
