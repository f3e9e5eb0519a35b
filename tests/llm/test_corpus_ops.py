"""Token counts, line dedup, embeddings, toxicity, personal data and the pipeline against brute force."""

import base64
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ledgermill.llm import embeddings, linededup, mixing, pii, simhash, tokencount, toxicity
from ledgermill.llm.common import Scratch

PATH = P.path("byte_bpe_50k.tiktoken")


# --- token counts

@pytest.mark.parametrize("block", [7, 1 << 16])
def test_token_counts(spark, odd_docs, block):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    scratch = Scratch(spark, "t")
    files, who = tokencount.write(odd_docs.repartition(3), scratch, PATH, P.PATTERN, 50256)
    docs = {(r["file"], r["ordinal"]): r["doc_id"] for r in who.collect()}
    got = {(r["file"], r["ordinal"]): r["n_tokens"] for r in tokencount.count(files, 50256, scratch, block=block).collect()}
    assert got.keys() == docs.keys()
    want = Counter((r["doc_id"], len(own.encode_ordinary(r["text"] or ""))) for r in odd_docs.collect())
    assert Counter((docs[k], n) for k, n in got.items()) == want
    # The files are flat: nothing but the ids and the identifiers.
    total = sum(r["length"] for r in files.collect())
    assert total == 2 * sum(n + 1 for n in got.values()) and files.count() == 3
    files, who = tokencount.write(odd_docs.limit(0), scratch, PATH, P.PATTERN, 50256)
    assert tokencount.count(files, 50256, scratch, block=block).count() == 0 == who.count()
    with pytest.raises(Exception, match="is a token of the vocabulary"):
        tokencount.write(odd_docs, scratch, PATH, P.PATTERN, 50255)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_raw_token_files(spark, tmp_path, block):
    files = {"a": [1, 2, 9, 9, 3, 9, 4, 5, 6, 7, 8, 1, 1, 1, 1, 1, 9], "b": [1, 2, 3], "c": [9], "d": [], "e": [9, 9, 1], "f": list(range(8)) * 9}
    for k, ids in files.items():
        (tmp_path / k).write_bytes(np.array(ids, "<u2").tobytes())
    got = tokencount.count(tokencount.list_files(spark, str(tmp_path)), 9, Scratch(spark, "t"), block=block).collect()
    for k, ids in files.items():
        parts = "".join(chr(i) for i in ids).split(chr(9))
        want = [len(p) for p in (parts if parts[-1] else parts[:-1])]
        assert [r["n_tokens"] for r in sorted((r for r in got if r["file"].endswith("/" + k)), key=lambda r: r["ordinal"])] == want


def test_a_token_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file: zeros but for an identifier near both ends."""
    size = 5 << 29  # bytes
    with open(tmp_path / "x", "wb") as f:
        f.truncate(size)
        for at in (10, size // 2 - 3):
            f.seek(2 * at)
            f.write(np.array([9], "<u2").tobytes())
    got = tokencount.count(tokencount.list_files(spark, str(tmp_path)), 9, Scratch(spark, "t"), block=1 << 24).orderBy("ordinal").collect()
    assert [r["n_tokens"] for r in got] == [10, size // 2 - 3 - 11, 2]


# --- line dedup

def brute_lines(docs):
    first, out = {}, {}
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = (text or "").split("\n")
        held = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for j in range(len(held) - 2):
            key = tuple(lines[i] for i in held[j : j + 3])
            if first.setdefault(key, (d, held[j])) != (d, held[j]):
                gone |= set(range(held[j], held[j + 2] + 1))
        out[d] = (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup(spark):
    r = random.Random(2)
    pool = [f"line {i}" for i in range(9)] + ["", " ", "\t"]
    docs = [(i, "\n".join(r.choices(pool, k=r.randint(0, 30)))) for i in range(120)] + [(200, None), (201, ""), (202, "a\nb"), (203, "a\nb"), (None, "line 1\nline 2\nline 3\nline 4\nline 5\n\nend")]
    df = spark.createDataFrame([(*d, "x", "y", 0) for d in docs], "doc_id long, text string, h1 string, d string, n_lines int")
    got = {x["doc_id"]: x for x in linededup.dedup(df).collect()}
    want = brute_lines(docs)
    assert {k: (x["text"], x["n_removed"]) for k, x in got.items()} == want
    for d, t in docs:
        assert got[d]["n_lines"] == (0 if t is None else t.count("\n") + 1)
    # No distinct line is lost.
    lines = lambda ts: {x for t in ts if t for x in t.split("\n") if x.strip()}
    assert lines(t for t, _ in want.values()) == lines(t for _, t in docs)


def test_line_dedup_odd(odd_docs):
    assert linededup.dedup(odd_docs).count() == odd_docs.count()
    assert linededup.dedup(odd_docs.limit(0)).count() == 0
    twice = odd_docs.where("doc_id = 12").union(odd_docs.where("doc_id = 12"))
    assert {x["n_removed"] for x in linededup.dedup(twice).collect()} == {7}


# --- embeddings

def brute_embeddings(rows, threshold=0.95):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in fine:
        for j in fine:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out.append((v, len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return Counter(out)


@pytest.mark.parametrize("block,tile", [(4096, 512), (20, 7)])
def test_embeddings(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TILE", tile)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 24))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + r.normal(size=24) * r.choice([0.1, 0.25, 1.0]))]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, None), (301, []), (302, [0.0] * 24), (303, [None] + [1.0] * 23), (304, [float("nan")] * 24), (305, [float("inf")] * 24), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, rows[3][1]), (None, [5.0, -1.0]), (5, rows[7][1])]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = embeddings.groups(df).collect()
    assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == brute_embeddings(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got if x["vec_id"] is not None)
    assert embeddings.groups(df.limit(0)).count() == 0
    assert embeddings.groups(df.where("vec_id = 302")).count() == 1


# --- toxicity

def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(labels.doc_id)))
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(docs.doc_id)).toPandas()
    ranks, toxic = scored["score"].rank(), scored["toxic"] == 1
    auc = (ranks[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert auc > 0.9 and ((scored["score"] >= 0.3) == toxic).mean() > 0.9
    assert scored["score"].between(0, 1).all()


def test_toxicity_odd(spark, odd_docs):
    labels = odd_docs.selectExpr("doc_id", "case when doc_id % 3 = 0 then 1 when doc_id % 3 = 1 then 0 end as toxic")
    model = toxicity.train(odd_docs, labels)
    scored = toxicity.score(odd_docs, model)
    assert scored.count() == odd_docs.count() and scored.where("score between 0 and 1").count() == odd_docs.count()
    assert toxicity.score(odd_docs.limit(0), model).count() == 0
    assert toxicity.train(odd_docs, labels.where("toxic = 1")).share == 1.0
    assert toxicity.train(odd_docs.limit(0), labels).regression is None
    assert toxicity.score(odd_docs, toxicity.train(odd_docs, labels.limit(0))).where("score = 0").count() == odd_docs.count()


class PlainKneserNey:
    """Both classes' models by dictionaries; ``texts``: (label, text)."""

    def __init__(self, texts):
        self.grams, self.pairs = Counter(), Counter()
        for y, text in texts:
            words = re.findall(r"[^\W\d_]+", text.lower())
            for before, word in zip(["\2", *words], words):
                self.pairs[y, before, word] += 1
                p = "\2" * (toxicity.ORDER - 1) + word + "\3"
                for i in range(len(word) + 1):
                    self.grams[y, p[i : i + toxicity.ORDER]] += 1
        kinds = {g for _, g in self.grams}
        self.seen = {}  # the sequences of each lower order, with the number of different symbols before
        for n in range(toxicity.ORDER - 1, 0, -1):
            self.seen[n] = Counter(g[1:] for g in kinds)
            kinds = set(self.seen[n])
        self.symbols = {g for g in kinds}

    @staticmethod
    def mixed(own, below, discount=toxicity.DISCOUNT):
        """``own``: counts in the context by what follows; the discounted probability over ``below``."""
        total = sum(own.values())
        return lambda x: below(x) if not total else (max(own.get(x, 0) - discount, 0) + discount * len(own) * below(x)) / total

    def symbol(self, y, context):
        p = lambda x: 1 / max(2, len(self.symbols) + 1)
        for n in range(1, toxicity.ORDER):
            start = context[len(context) - n + 1 :]
            p = self.mixed({g[-1]: c for g, c in self.seen[n].items() if g[:-1] == start}, p)
        return self.mixed({g[-1]: c for (k, g), c in self.grams.items() if k == y and g[:-1] == context}, p)

    def spelled(self, y, word):
        p, out = "\2" * (toxicity.ORDER - 1) + word + "\3", 1.0
        for i in range(len(word) + 1):
            out *= self.symbol(y, p[i : i + toxicity.ORDER - 1])(p[i + toxicity.ORDER - 1])
        return out

    def word(self, y, before):
        return self.mixed({w: c for (k, b, w), c in self.pairs.items() if k == y and b == before}, lambda w: self.spelled(y, w), toxicity.PAIR_DISCOUNT)

    def evidence(self, text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        spelled = [np.log(self.spelled(1, w)) - np.log(self.spelled(0, w)) for w in words]
        whole = [np.log(self.word(1, b)(w)) - np.log(self.word(0, b)(w)) for b, w in zip(["\2", *words], words)]
        out = []
        for x in (spelled, [a - b for a, b in zip(whole, spelled)]):
            n = min(toxicity.WINDOW, len(x))
            out += [np.mean(x), max(sum(x[i : i + n]) / n for i in range(len(x) - n + 1)), sum(sorted(x)[-toxicity.WORST :]) / toxicity.WORST] if x else [0.0] * 3
        return out


def test_scores_equal_a_plain_model(spark):
    """Every score of 50 documents; and each context's probabilities sum to one."""
    r = random.Random(6)
    bad, good = ["rot", "vile", "vilest", "röt"], ["calm", "kind", "kin", "kindest", "the", "of"]
    make = lambda y: " ".join(r.choice(bad) if y and r.random() < 0.4 else r.choice(good) for _ in range(r.randint(0, 30)))
    rows = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    plain = PlainKneserNey([(y, t) for _, t, y in rows])
    texts = [t for _, t, _ in rows] + ["Röt of, zzz! kind-rot 7", ""]
    want = np.array([plain.evidence(t) for t in texts])
    assert np.allclose(model.likelihoods.of_texts(texts), want, atol=1e-4)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert np.allclose([got[i] for i in range(50)], model.regression.predict(want)[:50], atol=1e-4)
    assert len({round(x, 6) for x in got.values()}) > 20
    for y in (0, 1):
        for context in ("\2\2\2\2", "\2\2\2v", "\2vil", "zzzz", "kind"):
            context = context.rjust(4, "\2")
            p = plain.symbol(y, context)
            assert abs(sum(map(p, plain.symbols)) + p("unseen") - 1) < 1e-9
        p = plain.word(y, "kind")
        known = {w for _, _, w in plain.pairs}
        left = 1 - sum(plain.spelled(y, w) for w in known)
        total = sum(c for (k, b, _), c in plain.pairs.items() if (k, b) == (y, "kind"))
        types = sum((k, b) == (y, "kind") for k, b, _ in plain.pairs)
        assert abs(sum(map(p, known)) + (toxicity.PAIR_DISCOUNT * types / total if total else 1) * left - 1) < 1e-9


def test_word_order_counts(spark):
    texts = ["white house stands"] * 20 + ["house white falls"] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id >= 20 as int) as toxic"))
    a, b = model.likelihoods.of_texts(["white house"]), model.likelihoods.of_texts(["house white"])
    assert np.allclose(a[:, :3], b[:, :3]) and (b[:, 3:] > a[:, 3:]).all()


def test_a_model_over_the_bound_is_trained_on_less(spark, odd_docs, monkeypatch):
    labels = odd_docs.selectExpr("doc_id", "doc_id % 2 as toxic").union(spark.createDataFrame([(13, 0), (13, 1)], "doc_id long, toxic long"))
    whole = toxicity.train(odd_docs, labels)
    monkeypatch.setattr(toxicity, "MAX_MODEL_BYTES", whole.likelihoods.nbytes - 1)
    assert toxicity.train(odd_docs, labels).likelihoods.nbytes < whole.likelihoods.nbytes


def test_every_labelled_row_is_trained_on(spark):
    """A word that only the toxic rows of the largest hashes have counts, however many rows there are before them."""
    from pyspark.sql import Window, functions as F

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") < 4500).cast("int").alias("toxic"))
    late = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")) > 4000
    text = F.when(late, "zork zork zork").when(F.col("toxic") == 1, "quix mild day").otherwise("calm mild day")
    rows = rows.withColumn("text", text)
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    zork, calm = model.likelihoods.of_texts(["zork", "calm"])
    assert zork[0] > 2 and calm[0] < -2
    pairs = spark.createDataFrame([(1, "zork"), (2, "calm")], "doc_id long, text string")
    zork, calm = (r["score"] for r in toxicity.score(pairs, model).orderBy("doc_id").collect())
    assert zork > 0.9 and calm < 0.3
    by = dict(zip(("ordinary", "toxic"), model.likelihoods.before.get(toxicity._keys(np.array([[toxicity._START]], np.uint64)))[:2]))
    assert by == {"ordinary": 500, "toxic": 4500}


# --- personal data

RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
)


def brute_pii(text):
    return sorted((m.start(), k, m.end()) for k, (_, rule, ok) in enumerate(RULES) for m in re.finditer(rule, text) if ok(m[0]))


def test_patterns_equal_regular_expressions():
    r = random.Random(8)
    bits = ["a@b.c", "@", "a", ".", "-", "@x.y", "1", "23", "255", "256", "0007", " ", "+", "(", ")", "4111111111111111", "1.2.3.4", "+1 (988) 555-2485", "é", "%", "\n", "x+y@z", "4041894974608795"]
    for _ in range(6000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert pii.patterns(text) == brute_pii(text), text
    for text in ("1" * 60_000, "a" * 60_000 + "@", "1." * 20_000, "+1" * 20_000, "a@" * 20_000, "+1" + " " * 60_000):
        pii.patterns(text), pii.nodes(text)


def test_pii(spark, odd_docs):
    base = ["write bob.42@mail8.example.com now", "call +1 (988) 555-2485 today", "host 42.144.35.254 is up", "card 4041894974608795. ok", "License 4.0 and version 3.1"]
    rows = [(i, f"{base[i % 5]} n{i % 7}", "x") for i in range(300)] + [(900, "please call (988) 555-2485 again", "x"), (901, "no data 7", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").unionByName(odd_docs.selectExpr("doc_id + 1000 as doc_id", "text", "'s' as spans"))
    got = pii.find(df).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
    by_id = {k: t or "" for k, t in texts}
    assert len(got) == sum(texts.values())
    for r in got:
        want = brute_pii(by_id[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(pii.show(want).split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
    by = {r["doc_id"]: r for r in got}
    assert by[900]["spans"] == "phone:12:26" and by[901]["spans"] == ""  # the field finds what lacks its prefix
    assert pii.find(df.limit(0)).count() == 0


def test_messages_are_exact_on_trees():
    made, r = pii.Field(), np.random.default_rng(1)
    own = [[(0, 1, "a1"), (2, 3, "b2"), (4, 5, "c3")]]
    made.index = pii._All()
    made.rows(own[0])
    made.unary, made.chain = r.normal(size=(len(made.index), 5)), r.normal(size=(5, 5))
    got, rows = made.marginals(own), made.rows(own[0])
    score = np.array([made.unary[x].sum(0) for x in rows])
    joint = np.exp(score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :] + made.chain[:, :, None] + made.chain[None])
    joint /= joint.sum()
    assert np.allclose(got[1], joint.sum((0, 2)), atol=1e-2) and np.allclose(got[0], joint.sum((1, 2)), atol=1e-2)


def test_loops_are_near_exact():
    """Skip edges that close loops: marginals against the sum over all labelings."""
    r = np.random.default_rng(3)
    own = [(0, 5, "11111"), (6, 11, "22222"), (40, 45, "11111"), (46, 51, "22222"), (90, 95, "11111")]
    made = pii.Field()
    chain, skip = pii.Field.edges([own])
    assert chain.tolist() == [[0, 1], [2, 3]] and skip.tolist() == [[0, 2], [1, 3], [2, 4]]
    made.index = pii._All()
    made.rows(own)
    for seen in (None, [0, 0, 3, 0, 0]):
        made.unary, made.chain = r.normal(size=(len(made.index), 5)) / 3, r.normal(size=(5, 5)) / 2
        made.skip = np.eye(5) * 2 - 1
        score = made.scores([own])
        if seen:
            score[2, 3] += pii.OBSERVED
        total = np.zeros((5, 5))
        for labels in np.ndindex(5, 5, 5, 5, 5):
            w = np.exp(sum(score[i, k] for i, k in enumerate(labels)) + sum(made.chain[labels[a], labels[b]] for a, b in chain) + sum(made.skip[labels[a], labels[b]] for a, b in skip))
            for i, k in enumerate(labels):
                total[i, k] += w
        got = made.marginals([own], seen)
        assert np.abs(got - total / total.sum(1, keepdims=True)).max() < 0.05
        if seen:
            assert got[0].argmax() == 3 == got[4].argmax()


def _spans_of_texts():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    own = {t: pii.nodes(t) for t in texts if t}
    own = {t: n for t, n in own.items() if n}
    return list(own.values()), [pii.labels(n, pii.patterns(t)) for t, n in own.items()]


def test_changed_mentions_are_found():
    """Trained on half of the documents: what it finds of the other half's mistyped and changed mentions."""
    documents, truth = _spans_of_texts()
    made, r = pii.train(documents[::2], truth[::2]), random.Random(99)
    agreement, right, wrong, missed, alone = made.skip, Counter(), Counter(), Counter(), 0
    for own, y in zip(documents[1::2], truth[1::2]):
        for nodes, labels, n in pii.copies(own, y, r):
            kind = "mention" if n < len(nodes) else "mistyped"
            seen = [k if kind == "mention" and i < n else 0 for i, k in enumerate(labels)]
            base = [(nodes[i][0], k - 1, nodes[i][1]) for i, k in enumerate(seen) if k]
            find = lambda: {tuple(x) for x in pii.added(nodes, made.marginals([nodes], seen), base)}  # noqa: B023,E731
            got = find()
            want = {(nodes[a][0], k - 1, nodes[b - 1][1]) for a, b, k in pii._groups(labels, nodes) if k and not any(seen[a:b])}
            if kind == "mistyped":  # a card with a wrong digit is no different from any other number
                want = {x for x in want if x[1] != 2}
            right[kind] += len(got & want)
            wrong[kind] += len(got - want)
            missed[kind] += len(want - got)
            if kind == "mention":
                made.skip = np.zeros((5, 5))
                alone += len((got & want) - find())
                made.skip = agreement
    print("personal data: right, wrong, missed, by agreement alone:", dict(right), dict(wrong), dict(missed), alone)
    for kind in ("mention", "mistyped"):
        assert right[kind] > 30 * wrong[kind] and right[kind] > 8 * missed[kind]
    assert alone > 0.9 * right["mention"]


def test_a_mention_needs_the_pattern_it_resembles(spark):
    """A card number with a wrong digit is found where the document holds the right one, however far away."""
    r = random.Random(12)
    number = lambda ok: next(x for x in (str(r.randrange(10**15, 10**16)) for _ in range(10**6)) if pii.luhn(x) == ok)
    rows = [(i, f"pay with {number(i % 2 == 0)} now, version 3.{i % 9}") for i in range(300)]
    good = "4041894974608795"
    far = "some words " * 300
    rows += [(900, f"card {good}. {far} again {good[:-2]}0{good[-1]} ok"), (901, f"card. {far} again {good[:-2]}0{good[-1]} ok")]
    got = {x["doc_id"]: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[-2][1].rindex("4041894974608")
    assert got[900]["spans"] == f"card:5:21,card:{at}:{at + 16}" and got[900]["n_card"] == 1 and got[901]["spans"] == ""


def test_parts_do_not_matter(monkeypatch):
    documents, truth = _spans_of_texts()
    made = pii.train(documents[:300], truth[:300])
    whole = made.marginals(documents[:40], [k for t in truth[:40] for k in t])
    each = np.concatenate([made.marginals([d], t) for d, t in zip(documents[:40], truth[:40])])
    assert np.abs(whole - each).max() < 0.01


def test_recurring_tokens_are_tied():
    """Neighbouring nodes with words between have no chain edge, so a token's next mention has a skip edge."""
    far = pii.nodes("call 555-2485 today or later then again 555-2485")
    near = pii.nodes("call 555-2485 555-2485")
    chain, skip = pii.Field.edges([far])
    assert len(chain) == 0 and skip.tolist() == [[0, 1]]
    chain, skip = pii.Field.edges([near])
    assert chain.tolist() == [[0, 1]] and len(skip) == 0


def test_long_documents_train(spark, monkeypatch):
    """Where all documents are longer than a stretch, the field still learns from them."""
    monkeypatch.setattr(pii, "SAMPLE_DOCUMENT", 6)
    base = ["call +1 (988) 555-2485 today", "mail bob.42@mail8.example.com now", "version 3.1 of n7", "host 42.144.35.254 is up"]
    rows = [(i, " and ".join(base[(i + k) % 4] for k in range(8))) for i in range(200)]
    rows += [(900, "please call (988) 555-2485 again " + "and " * 9 + " and ".join(base[2] for _ in range(6)))]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] == "phone:12:26"
    found = spark.createDataFrame([(1, [[0, 3, 4], [90, 0, 95]], list(range(0, 100, 5)), list(range(2, 102, 5)), [f"n{i}" for i in range(20)])], "doc_id long, base array<array<int>>, s array<int>, e array<int>, token array<string>")
    r = pii._stretches(found).first()
    at = r["s"][0] // 5
    assert r["s"] == list(range(5 * at, 5 * at + 30, 5)) and r["token"] == [f"n{i}" for i in range(at, at + 6)]
    assert pii._stretches(found.where("size(s) < 6")).count() == 0


# --- pipeline

def test_keep_one_and_mix(spark, odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.count() == simhash.groups(odd_docs, 5).select("group").distinct().count()
    assert sorted(kept.columns) == sorted(odd_docs.columns)
    unique = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r for r in mixing.mix(unique).documents.collect() if r["taken"]}
    words = Counter()
    for r in mixing.apply(unique).collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {k: r["taken"] for k, r in taken.items()}


def test_mix_of_rows_that_share_an_id(spark):
    """A row's share is its own: neither its text nor its limit is that of another row of the same doc_id."""
    words = lambda n, w: " ".join([w] * n)
    data = [(1, words(100, "a"), "s"), (1, words(10, "b"), "s"), (2, words(40, "c"), "t"), (2, words(40, "c"), "t"), (None, words(7, "d"), None), (None, words(7, "e"), None), (3, None, "s"), (3, "", "t")]
    df = spark.createDataFrame([(*x, 1, "z") for x in data], "doc_id long, text string, source string, taken int, `_key` string")
    mixed = mixing.apply(df, block=4)
    assert mixed.dtypes == df.dtypes
    got, sizes = Counter(), Counter()
    for r in mixed.collect():
        got[r["doc_id"], r["text"].split()[0]] += len(r["text"].split())
    for d, t, _ in data:
        if t:
            sizes[d, t.split()[0]] += len(t.split())
    assert all(got[k] <= 2 * sizes[k] for k in got) and set(got) <= set(sizes)
    want = Counter()
    for r in mixing.mix(df, block=4).documents.collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    by_size = Counter()
    for (d, w), n in got.items():
        by_size[d, {"a": 100, "b": 10, "c": 40, "d": 7, "e": 7}[w]] += n
    assert by_size == +want
    slots = mixing._slots(mixing.mix(df, block=1).sources, Scratch(spark, "t"), 1)
    assert slots.count() == slots.select("slot").distinct().count() > 100  # no two blocks have one place in the schedule


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "t")
    tables = [docs]
    for name, stage in c.STAGES:
        tables.append(scratch.cut(stage(spark, tables[-1], sf_dir)))
        if name != "bpe":
            assert tables[-1].dtypes == docs.dtypes
    clean, lines, near, mixed, ids = tables[1:]
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    want = {k: t for k, (t, n) in brute_lines(texts.items()).items() if re.search(r"[^\x20\x09-\x0D]", t) or not n}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in simhash.groups(lines, 5).select("component_id").distinct().collect()}
    got = Counter((r["doc_id"], r["n_tokens"]) for r in ids.collect())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == Counter((r["doc_id"], len(own.encode_ordinary(r["text"]))) for r in mixed.collect())
