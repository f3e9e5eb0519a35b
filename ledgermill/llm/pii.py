"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Nodes of a document's field are its tokens that hold a digit or an at-sign; every other token is outside by
definition.  Neighbouring nodes share transition potentials, and tokens that recur in the document or resemble
each other (the same digits, or the same first or last six of them, or one mailbox) share agreement potentials
however far apart they are: each is tied to the last one like it, so a token that recurs n times has n - 1 such
edges.  Nodes inside a pattern's span are observed, so what a pattern is sure of spreads along these edges to
mentions that it cannot read.  Loopy sum-product message passing runs until messages settle.  Runs of nodes of
which a kind is likelier than not, and one node's marginal is ``SURE`` or more, become spans unless a span found by
pattern overlaps them; those always stay.

The field is trained piecewise here, on a bounded sample of the documents that have nodes (``SAMPLE``).  Unary
potentials are a softmax regression on token shapes and neighbours; its cases are the patterns' own spans and
mistyped copies of them (``mistype``: a prefix dropped, a digit changed, separators broken), so it learns what data
looks like that the patterns miss.  Transitions and agreements are smoothed log ratios of counts; agreements are
counted on copies in which spans, and other tokens, are mentioned once more, changed (``mention``).

Memory: documents go in parts of ``PART_NODES`` nodes, a longer one alone; a node takes its edges' messages, five
numbers each.

Defined results: a null text is the empty text; a text without nodes has no spans; repeated rows get equal
results; an empty table gives an empty table.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, lean, ship

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample, about; whole documents.
SAMPLE = 4000
#: Nodes of the training sample, and of one of its documents' stretches, at most; all nodes are labelled all the same.
SAMPLE_NODES, SAMPLE_DOCUMENT = 200_000, 200
SURE = 0.9
#: Message passing ends when no message changes by more than SETTLED, or after ROUNDS.
SETTLED, ROUNDS = 1e-3, 100
#: Nodes of documents whose messages are passed at once.
PART_NODES = 50_000
#: Log odds of an observed label.
OBSERVED = 15.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never starts inside a run of digits: what follows the run decides, and it follows every start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]")
_EDGE = "\"'.,;:!?<>[]{}"


def luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def nodes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens with a digit or an at-sign, without punctuation at their edges."""
    out, at = [], 0
    while m := _NODE.search(text, at):
        start = end = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        size = len(text)
        while end < size and not text[end].isspace():
            end += 1
        token = text[start:end]
        inner = token.strip(_EDGE)
        start += len(token) - len(token.lstrip(_EDGE))
        out.append((start, start + len(inner), inner))
        at = end
    return out


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _bucket(n: int) -> int:
    return n if n <= 4 else 5 if n <= 6 else 7 if n <= 8 else 9 if n <= 11 else 12 if n <= 19 else 20


def features(token: str) -> list[str]:
    digits = sum(c.isdigit() for c in token)
    letters = {"u" if c.isupper() else "l" for c in token if c.isalpha()}
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token))
    marks = sorted({c for c in token if not c.isalnum()})
    return ["bias", f"d{_bucket(digits)}", "L" + "".join(sorted(letters)), f"dots{min(token.count('.'), 4)}", f"runs{min(shape.count('9'), 4)}", "s" + shape[:24], *[f"m{c}" for c in marks[:8]]]


@dataclass
class Field:
    """The random field's potentials.  Label 0 is outside, label k + 1 is KINDS[k]."""

    index: dict[str, int] = field(default_factory=dict)
    unary: np.ndarray = field(default_factory=lambda: np.zeros((0, 5)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))

    def rows(self, own: list[tuple[int, int, str]], first: int = 0, last: int | None = None) -> list[list[int]]:
        """Feature ids of a document's nodes, or some of them; neighbours count if at most a space or two is between."""
        last, out, of = len(own) if last is None else last, [], {}
        for j in range(max(0, first - 1), min(len(own), last + 1)):
            of[j] = features(own[j][2])
        for i in range(first, last):
            all_f = list(of[i])
            for j, name in ((i - 1, "p"), (i + 1, "n")):
                near = 0 <= j < len(own) and self._near(own[min(i, j)], own[max(i, j)])
                all_f += [f"{name}{x}" for x in of[j][1:3]] if near else [f"{name}-"]
            out.append([self.index[x] for x in all_f if x in self.index])
        return out

    @staticmethod
    def _near(a: tuple, b: tuple) -> bool:
        return b[0] - a[1] <= 2

    @classmethod
    def edges(cls, documents: list[list[tuple[int, int, str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(node, node) of the chain and of the skips, numbered over all documents."""
        chain, skip, base = [], [], 0
        for own in documents:
            last: dict[str, int] = {}
            for i, (_, _, token) in enumerate(own):
                tied = i > 0 and cls._near(own[i - 1], own[i])
                if tied:
                    chain.append((base + i - 1, base + i))
                back = set()  # like tokens tie once, whatever they have in common
                for key in likeness(token):
                    if key in last and not (tied and last[key] == i - 1):
                        back.add(last[key])
                    last[key] = i
                skip += [(base + j, base + i) for j in sorted(back)]
            base += len(own)
        return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)

    def scores(self, documents: list[list[tuple[int, int, str]]], step: int = 20_000) -> np.ndarray:
        out = [np.zeros((0, 5))]
        for own in documents:
            for k in range(0, len(own), step):
                rows = self.rows(own, k, min(len(own), k + step))
                part = np.zeros((len(rows), 5))
                flat = np.fromiter((f for r in rows for f in r), np.int64)
                np.add.at(part, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), self.unary[flat])
                out.append(part)
        return np.concatenate(out)

    def marginals(self, documents: list[list[tuple[int, int, str]]], observed: list[int] | None = None) -> np.ndarray:
        """Rows of label probabilities.  ``observed``: labels of the nodes that patterns found, 0 for the others."""
        score = self.scores(documents)
        if observed is not None and len(score):
            seen = np.array(observed, np.int64)
            at = np.flatnonzero(seen)
            score[at, seen[at]] += OBSERVED
        chain, skip = self.edges(documents)
        ends = np.concatenate([chain, skip, chain[:, ::-1], skip[:, ::-1]])
        if not len(ends):
            return _softmax(score)
        half = len(chain) + len(skip)
        # Edges of one kind and direction are in a row, so each kind's potentials exist once.
        kinds = [(0, len(chain), np.exp(self.chain)), (len(chain), half, np.exp(self.skip)), (half, half + len(chain), np.exp(self.chain.T)), (half + len(chain), 2 * half, np.exp(self.skip.T))]
        message = np.zeros((len(ends), 5))
        for _ in range(ROUNDS):
            belief = score.copy()
            for c in range(5):
                belief[:, c] += np.bincount(ends[:, 1], message[:, c], len(score))
            out = belief[ends[:, 0]]
            out[:half] -= message[half:]
            out[half:] -= message[:half]
            out = _softmax(out)
            new = np.concatenate([np.log(out[a:b] @ potential) for a, b, potential in kinds])
            new -= new.max(1, keepdims=True)
            new = 0.5 * message + 0.5 * new
            moved = np.abs(new - message).max()
            message = new
            if moved < SETTLED:
                break
        for c in range(5):
            score[:, c] += np.bincount(ends[:, 1], message[:, c], len(score))
        return _softmax(score)


def likeness(token: str) -> list[str]:
    """What a token has in common with those that agree with it."""
    digits = "".join(c for c in token if c.isdigit())
    keys = ["t" + token.lower()]
    if len(digits) >= 5:
        keys.append("d" + digits)
    if len(digits) >= 7:
        keys += ["p" + digits[:6], "s" + digits[-6:]]
    box = token.split("@")[0].lower()
    return [*keys, "u" + box] if len(box) >= 3 else keys


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def labels(own: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the span that a node lies in, 0 for none."""
    out, j = [], 0
    for s, e, _ in own:
        while j < len(spans) and spans[j][2] <= s:
            j += 1
        out.append(spans[j][1] + 1 if j < len(spans) and spans[j][0] < max(e, s + 1) else 0)
    return out


def _groups(truth: list[int], own: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(first, last + 1, label) of the runs of near nodes of one label; nodes outside are runs of their own."""
    out: list[list[int]] = []
    for i, y in enumerate(truth):
        if out and y and out[-1][2] == y and y > 2 and Field._near(own[i - 1], own[i]):
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, y])
    return [tuple(x) for x in out]


def _changed(token: str, r: random.Random) -> str:
    """The token with one digit another."""
    at = r.choice([i for i, c in enumerate(token) if "0" <= c <= "9"] or [-1])
    return token if at < 0 else token[:at] + str((int(token[at]) + r.randint(1, 9)) % 10) + token[at + 1 :]


def mistype(tokens: list[str], kind: int, r: random.Random) -> list[str]:
    """A span's tokens as a writer may get them wrong, so that no pattern finds them."""
    token = tokens[0]
    if kind == 0:
        box, _, domain = token.partition("@")
        return [r.choice([f"{box}@@{domain}", f"{box}@{domain.split('.')[0]}", f"{box}@{domain.replace('.', ',')}"])]
    if kind == 1:
        parts, at = token.split("."), r.randrange(4)
        long = ".".join([*parts[:at], str(r.randint(256, 999)), *parts[at + 1 :]])
        return [r.choice([long, ",".join(parts), token.replace("1", "l", 1).replace("0", "O", 1) if set("01") & set(token) else long])]
    if kind == 2:
        at = r.randrange(len(tokens))
        return [*tokens[:at], _changed(tokens[at], r), *tokens[at + 1 :]]
    return r.choice([[token.lstrip("+"), *tokens[1:]], tokens[1:] or [token.lstrip("+")], [token.lstrip("+"), *[re.sub("[() -]", "", t) for t in tokens[1:]]]])


def mention(tokens: list[str], kind: int, r: random.Random) -> list[str]:
    """A span's tokens as a later mention may have them: readable for who knows the first."""
    if kind == 0:
        return [tokens[0].split("@")[0] + "@"]
    if kind == 1:
        return [tokens[0].replace(".", r.choice("-_"))]
    if kind == 2:
        return [_changed("".join(tokens), r)]
    return [re.sub("[^0-9]", "", "".join(tokens))]


def copies(own: list[tuple[int, int, str]], truth: list[int], r: random.Random) -> Iterator[tuple[list[tuple[int, int, str]], list[int], int]]:
    """A document with mistyped spans, and one with changed mentions after its end: nodes, labels, and how many of the
    nodes are the document's own."""
    def put(out: list, tokens: list[str], at: int) -> int:
        for t in tokens:
            out.append((at, at + len(t), t))
            at += len(t) + 1
        return at

    spans = [g for g in _groups(truth, own) if g[2]]
    if not spans:
        return
    nodes_, labels_ = [], []
    for a, b, y in _groups(truth, own):
        tokens = [t for _, _, t in own[a:b]]
        tokens = mistype(tokens, y - 1, r) if y else tokens
        put(nodes_, tokens, own[a][0])
        labels_ += [y] * len(tokens)
    yield nodes_, labels_, len(nodes_)
    nodes_, labels_ = list(own), list(truth)
    at = own[-1][1] + 20
    others = [g for g in _groups(truth, own) if not g[2] and len(likeness(own[g[0]][2])) > 2]
    for a, b, y in spans + others[: len(spans)]:
        tokens = [t for _, _, t in own[a:b]]
        tokens = mention(tokens, y - 1, r) if y else [_changed(tokens[0], r)]
        at = put(nodes_, tokens, at) + 20
        labels_ += [y] * len(tokens)
    yield nodes_, labels_, len(own)


def train(documents: list[list[tuple[int, int, str]]], truth: list[list[int]], steps: int = 300, ridge: float = 1e-4, seed: int = 7) -> Field:
    made, r = Field(), random.Random(seed)
    if not any(truth):
        return made
    cases = [c for own, y in zip(documents, truth, strict=True) if own for c in copies(own, y, r)]
    mistyped, mentioned = ([c for c in cases if (c[2] < len(c[0])) == m] for m in (False, True))
    plain = [*zip(documents, truth, strict=True), *[c[:2] for c in mistyped]]
    y = np.array([k for _, t in plain for k in t], np.int64)
    seen: Counter = Counter()
    made.index = _All()
    rows = [x for own, _ in plain for x in made.rows(own)]
    for x in rows:
        seen.update(x)
    names = [k for k in made.index if seen[made.index[k]] >= 2]
    keep = {made.index[k]: i for i, k in enumerate(names)}
    made.index = {k: i for i, k in enumerate(names)}
    owner = np.array([i for i, x in enumerate(rows) for f in x if f in keep], np.int64)
    feature = np.array([keep[f] for x in rows for f in x if f in keep], np.int64)
    weights, m, v = (np.zeros((len(names), 5)) for _ in range(3))
    target = np.eye(5)[y]
    for step in range(1, steps + 1):
        score = np.zeros((len(y), 5))
        np.add.at(score, owner, weights[feature])
        slope = np.zeros_like(weights)
        np.add.at(slope, feature, (_softmax(score) - target)[owner])
        slope = slope / len(y) + ridge * weights
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        weights = weights - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    made.unary = weights
    for of, symmetric in ((plain, False), ([*plain, *[c[:2] for c in mentioned]], True)):
        ends, y = made.edges([own for own, _ in of])[symmetric], np.array([k for _, t in of for k in t], np.int64)
        joint = np.full((5, 5), 0.5)
        if len(ends):
            np.add.at(joint, (y[ends[:, 0]], y[ends[:, 1]]), 1)
        if symmetric:  # against the geometric mean of the labels' counts, so that a common label agrees as strongly as a rare one
            joint = (joint + joint.T) / 2 + 2 * np.eye(5)
            made.skip = np.clip(np.log(joint / np.sqrt(joint.sum(1)[:, None] * joint.sum(0)[None, :])), -6, 0)
        else:
            made.chain = np.clip(np.log(joint * joint.sum() / (joint.sum(1)[:, None] * joint.sum(0)[None, :])), -2, 2) / 2
    return made


class _All(dict):
    """Numbers every feature that is asked for."""

    def __contains__(self, key: str) -> bool:
        self.setdefault(key, len(self))
        return True


def added(own: list[tuple[int, int, str]], p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of runs of sure nodes of one kind that no pattern's span overlaps."""
    runs: list[list] = []  # start, kind, end, the surest node's marginal
    best = p[:, 1:].argmax(1) if len(p) else []
    previous = None
    for i, (s, e, _) in enumerate(own):
        at = float(p[i, 1 + best[i]])
        kind = int(best[i]) if at > 0.5 and e > s else None
        if kind is not None and kind == previous and kind >= 2 and s - runs[-1][2] <= 2:
            runs[-1][2:] = e, max(runs[-1][3], at)
        elif kind is not None:
            runs.append([s, kind, e, at])
        previous = kind
    spans = [r[:3] for r in runs if r[3] >= SURE]
    out, j = [], 0
    ends = sorted((s, e) for s, _, e in base)
    for s, k, e in spans:
        while j < len(ends) and ends[j][1] <= s:
            j += 1
        if not any(a < e and b > s for a, b in ends[max(0, j - len(KINDS)) : j + len(KINDS)]):
            out.append((s, k, e))
    return out


def _candidates(df: DataFrame, text: str, doc_id: str, scratch: Scratch) -> DataFrame:
    """doc_id, base (spans as text) and the nodes (s, e, token) of every row: one pass over the texts."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("base", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("e", T.ArrayType(T.IntegerType())), T.StructField("token", T.ArrayType(T.StringType()))])
    kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                columns: list[list] = [[], [], [], []]
                for cell in batch.column(1):
                    t = cell.as_py()
                    own = nodes(t)
                    columns[0].append([list(x) for x in patterns(t)] if own else [])
                    for c, values in zip(columns[1:], zip(*own, strict=True) if own else ((), (), ()), strict=True):
                        c.append(list(values))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    ship(df.sparkSession)
    return scratch.cut(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema))


def _stretches(found: DataFrame) -> DataFrame:
    """Documents of more than ``SAMPLE_DOCUMENT`` nodes are cut to that many in a row, wherever their hash says."""
    spare = F.greatest(F.size("s") - SAMPLE_DOCUMENT, F.lit(0))
    at = F.pmod(F.xxhash64("doc_id", "token", F.lit(3)), spare + 1).cast("int") + 1
    cut = found.withColumn("_at", at).withColumns({c: F.slice(c, F.col("_at"), F.lit(SAMPLE_DOCUMENT)) for c in ("s", "e", "token")})
    inside = lambda x: (F.get(x, F.lit(2)) > F.element_at("s", 1)) & (F.get(x, F.lit(0)) <= F.element_at("e", -1))
    return cut.withColumn("base", F.filter("base", inside)).drop("_at")


def find(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, name: str = "pii") -> DataFrame:
    """doc_id, ``n_email`` .. ``n_phone`` and ``base_sha256`` of the patterns' spans, and all ``spans``."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, name)
    found = _candidates(df, text, doc_id, scratch)
    some = found.where(F.size("s") > 0)
    one_in = max(1, some.count() // sample)
    taken = _stretches(some.where(F.pmod(F.xxhash64("doc_id", "token"), F.lit(one_in)) == 0)).limit(2 * sample).collect()
    documents, truth, total = [], [], 0
    for r in sorted(taken, key=lambda r: (str(r["doc_id"]), r["token"], r["s"])):
        if total + len(r["s"]) <= SAMPLE_NODES:
            documents.append(list(zip(r["s"], r["e"], r["token"], strict=True)))
            truth.append(labels(documents[-1], [tuple(x) for x in r["base"]]))
            total += len(r["s"])
    model = spark.sparkContext.broadcast(train(documents, truth))  # features of at most SAMPLE_NODES nodes
    schema = T.StructType([found.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                for part in _parts(batch):
                    base = [[tuple(x) for x in row] for row in part.column(1).to_pylist()]
                    own = [list(zip(*x, strict=True)) for x in zip(*[part.column(c).to_pylist() for c in (2, 3, 4)], strict=True)]
                    p = model.value.marginals(own, [y for o, b in zip(own, base, strict=True) for y in labels(o, b)])
                    spans, at = [], 0
                    for b, o in zip(base, own, strict=True):
                        spans.append(show(sorted([*b, *added(o, p[at : at + len(o)], b)])))
                        at += len(o)
                    counts = [[sum(k == n for _, k, _ in b) for b in base] for n in range(len(KINDS))]
                    hashes = [hashlib.sha256(show(b).encode()).hexdigest() for b in base]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return found.mapInArrow(label, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in parts of about PART_NODES nodes; a row of more is a part of its own."""
    start = total = 0
    for i, n in enumerate(batch.column(2).value_lengths().to_pylist()):
        if total and total + n > PART_NODES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(batch):
        yield batch.slice(start)
