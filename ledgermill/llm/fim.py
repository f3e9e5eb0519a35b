"""Fill-in-the-middle transformation of texts, cut at token boundaries by counts of content-defined chunks.

Tokens are runs of ASCII letters and single other code points (``TOKEN``).  A text is cut into chunks where a rolling
hash of its last ``WINDOW`` code points has ``BITS`` zero bits, so that equal passages give equal chunks wherever they
stand.  A chunk is summed up by its number of tokens and whether it begins and ends with a letter; the summaries of
chunks met before come from a cache that is keyed, and so verified, by their content.  A run of letters that goes on
over a boundary is one token, so the counts of chunks combine to those of the text; they lead to the one chunk that
holds a cut, and only that is searched for its place.

The cache belongs to a task and is bounded (``CACHE`` code points in each of two generations), so memory does not grow
with the corpus, a lost executor loses nothing but the cache, and results never depend on what is in it.  Texts are
hashed in blocks of ``BLOCK`` code points.  Nothing is shuffled.

Defined results: a null text is the empty text, which is left plain; a null id counts as the empty string in the draw;
texts that hold a sentinel are left plain; repeated rows change alike; an empty table gives an empty table; other
columns are passed on, and one that is named like the result (``out``) gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import lean, ship

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points under the rolling hash, a power of two; zero bits that end a chunk; code points of a chunk at most.
WINDOW, BITS, LONGEST = 32, 8, 4096
#: Code points hashed at a time; code points of a generation of the cache.
BLOCK, CACHE = 1 << 20, 1 << 24

KIND = "n long, form string, prefix_chars long, middle_chars long, output string"


def _ends(text: str) -> list[int]:
    """Where the chunks of a text end."""
    ends: list[int] = []
    for at in range(0, len(text), BLOCK):
        before = min(WINDOW, at)
        codes = np.frombuffer(text[at - before : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        h = codes * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        step = 1
        while step < WINDOW:  # h[i] then sums the terms of 2 * step code points, each shifted by its distance from i
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h, step = more, 2 * step
        ends += (np.flatnonzero(h[before:] < np.uint32(1 << (32 - BITS))) + (at + 1)).tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    last, found = 0, []
    for end in ends:
        if end - last > LONGEST:
            found.extend(range(last + LONGEST, end, LONGEST))
        found.append(end)
        last = end
    return found


#: Letters as one byte, all else as white space.
_LETTERS = bytes(97 if chr(i).isalpha() and i < 128 else 32 for i in range(256))


def summarise(chunk: str) -> tuple[int, bool, bool]:
    """Number of tokens, and whether a letter begins and ends the chunk, which is not empty."""
    seen = chunk.encode("latin-1", "replace").translate(_LETTERS)  # one byte for a code point
    return len(chunk) - seen.count(b"a") + len(seen.split()), seen[0] == 97, seen[-1] == 97


class Chunks:
    """Summaries of chunks by their content."""

    def __init__(self, most: int = CACHE):
        self.young, self.old, self.held, self.most = {}, {}, 0, most

    def clear(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summarise(chunk)
            if self.held + len(chunk) > self.most:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found


class Counted:
    """A text whose tokens are counted by chunks."""

    def __init__(self, text: str, chunks: Chunks):
        self.text, self.ends = text, _ends(text) if text else []
        self.starts, self.goes_on, new = [0, *self.ends][:-1], [], []
        letter_before = False
        for a, b in zip(self.starts, self.ends, strict=True):
            n, first, last = chunks.summary(text[a:b])
            self.goes_on.append(letter_before and first)
            new.append(n - self.goes_on[-1])
            letter_before = last
        self.upto = list(accumulate(new))
        self.n = self.upto[-1] if new else 0

    def place(self, k: int) -> int:
        """Where the first k tokens end."""
        if k == self.n:
            return len(self.text)
        c = bisect_right(self.upto, k)
        skip = k - (self.upto[c - 1] if c else 0) + self.goes_on[c]
        a = self.starts[c]
        for i, m in enumerate(TOKEN.finditer(self.text[a : self.ends[c]])):
            if i == skip:
                return a + m.start()
        raise AssertionError("counts of chunks do not add up")


def transform_text(text: str, doc_id: str, chunks: Chunks, seed: int, percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    counted = Counted(text, chunks)
    n = counted.n
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = (counted.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(df: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, text: str = "text", doc_id: str = "doc_id", out: str = "fim") -> DataFrame:
    """The input with a struct ``out`` (n, form, prefix_chars, middle_chars, output): ``percent`` of the texts are
    rearranged, ``spm_percent`` of these with the suffix first; the draw depends on seed and id alone."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        chunks = Chunks()
        with lean(chunks):
            for texts, ids in batches:
                found = [transform_text(t.as_py(), i.as_py(), chunks, seed, percent, spm_percent) for t, i in zip(texts, ids, strict=True)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
                yield pa.StructArray.from_arrays(columns, names=[x.split()[0] for x in KIND.split(", ")])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}  # as types, not as text
    ship(df.sparkSession)
    empty = F.lit("")
    return df.withColumn(out, F.arrow_udf(run, KIND)(F.coalesce(F.col(text), empty), F.coalesce(F.col(doc_id).cast("string"), empty)))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  A text with a sentinel is never rearranged, so each stands once."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda start, end: F.substring(output, start + len(PREFIX), end - start - len(PREFIX))
    rest = F.length(output) + 1
    return (
        F.when(form == "psm", F.concat(after(p, s), after(m, rest), after(s, m)))
        .when(form == "spm", F.concat(after(p, m), after(m, rest), after(s, p)))
        .otherwise(output)
    )
