"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Encoding works on a whole Arrow batch at once.  The texts are cut by the vocabulary's pattern, each distinct
piece of the batch is encoded once, and pieces are laid out as padded matrices of token ids, one matrix per
length bucket.  Each round merges, in every row, the leftmost pair of minimum rank: ranks of pairs come from
a hashed pair table, the pair is replaced, and the row is compacted by one column.  Rows without a mergeable
pair leave the matrix.  Pieces longer than ``MATRIX_BYTES`` (runs without a break) would need as many rounds
as they have bytes over a row as wide, so they take the same merges in the same order from a heap: the ids are the same,
and the README gives the times of both.

Defined results: a null text is the empty text; an empty text has no tokens and decodes to no bytes; lone
surrogates cannot occur in Spark strings; equal rows give equal results; an empty table gives an empty
table.  Only the text column is read besides the columns asked for, so clashing names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lean, ship

#: Fixed value: the pattern of which it is known that a match starts at every single space between two other characters.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MATRIX_BYTES = 4096
#: Most cells of one matrix; a larger bucket is encoded in several.
MATRIX_CELLS = 1 << 16
#: Stretches that a worker remembers between batches, in each of two generations, so that its memory stays bounded.
MEMORY_PIECES = 200_000
NO_RANK = np.int32(2**31 - 1)
#: A stretch's ids as 32-bit numbers, the ids in decimal, and the bytes that they decode to.
Stretch = tuple[bytes, str, bytes]


class PairTable:
    """(left id, right id) -> id of their concatenation, by open addressing over numpy arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._hash(keys)
        while len(keys):
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & (size - 1)
        self.mask = size - 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NO_RANK where the two do not merge, or either is padding (negative)."""
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._hash(keys)
        out = np.full(keys.shape, NO_RANK, np.int32)
        todo = np.flatnonzero(keys.ravel() >= 0)
        flat, slots, res = keys.ravel(), slot.ravel(), out.ravel()
        while len(todo):
            seen = self.keys[slots[todo]]
            hit = seen == flat[todo]
            res[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return res.reshape(keys.shape)


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank
        self.pairs = PairTable(pairs)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.decimal = list(map(str, range(max(self.bytes_of) + 1)))
        self.memory: dict[str, Stretch] = {}
        self.older: dict[str, Stretch] = {}
        self.plain_words = pattern == SPACE_PATTERN
        # Texts in which a space may be inside a match are cut as a whole: all of them with another pattern.
        self.odd_space = re.compile(r"\s | \s|\A | \Z|\0" if pattern == SPACE_PATTERN else "").search

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int] | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif len(p) > MATRIX_BYTES:
                out[i] = self._by_heap(p)
            else:
                buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._by_matrix([pieces[j] for j in part], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.single[flat]
        ids[np.arange(width) >= lengths[:, None]] = -1
        found = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), [None] * n
        while len(rows):
            best = found.argmin(1)
            at = np.arange(len(rows))
            rank = found[at, best]
            done = rank == NO_RANK
            if done.any():
                for r, line in zip(rows[done], ids[done], strict=True):
                    out[r] = line[line >= 0].tolist()
                keep = ~done
                rows, ids, found, best, rank = rows[keep], ids[keep], found[keep], best[keep], rank[keep]
                if not len(rows):
                    break
                at = np.arange(len(rows))
            n, width = ids.shape
            ids[at, best] = rank
            cols = np.arange(width)
            ids = ids[cols != best[:, None] + 1].reshape(n, width - 1)
            if width == 2:
                found = np.full((n, 1), NO_RANK, np.int32)
                continue
            found = found[cols[:-1] != best[:, None]].reshape(n, width - 2)
            left = np.maximum(best - 1, 0)
            found[at, left] = self.pairs.find(ids[at, left], ids[at, left + 1])
            right = np.minimum(best, width - 3)
            found[at, right] = self.pairs.find(ids[at, right], ids[at, right + 1])
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        n = len(piece)
        ids = [int(self.single[b]) for b in piece]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        start = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        none = int(NO_RANK)
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(start) if r != none]
        heapq.heapify(heap)
        alive = [True] * n
        pair: dict[int, int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j >= 0:
                key = (ids[i] << 20) | ids[j]
                if key not in pair:
                    pair[key] = int(self.pairs.find(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
                if pair[key] != none:
                    heapq.heappush(heap, (pair[key], i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def encode_batch(self, texts: list[str]) -> Iterator[list[Stretch]]:
        """For each text its stretches in order.

        A stretch starts at a single space between two characters that are not white space, where the
        pattern always starts a match; so a stretch is cut alike wherever it stands, and each distinct one
        is cut, encoded and decoded once while it is remembered: what no batch has used since the memory was last
        full is forgotten.  A text in which some space is not of that kind is cut as a whole.
        """
        cut = []
        for text in texts:
            parts = [text] if self.odd_space(text) else text.split(" ")
            parts[0] = "\0" + parts[0]  # marks the stretch that has no space before it
            cut.append(parts)
        wanted = set().union(*cut)
        new = wanted.difference(self.memory)
        if len(self.memory) + len(new) > MEMORY_PIECES:
            self.older.clear()
            self.older |= self.memory
            self.memory.clear()
            new = wanted
        known = new.intersection(self.older)
        self.memory |= zip(known, map(self.older.__getitem__, known), strict=True)
        self._remember(list(new - known))
        return (list(map(self.memory.__getitem__, parts)) for parts in cut)

    def _remember(self, new: list[str]) -> None:
        pieces = []
        for p in new:
            whole = p[1:] if p[:1] == "\0" else " " + p
            # Letters after a space or nothing are one match; of other letters than A to Z the pattern's library decides.
            pieces.append([whole] if self.plain_words and p.isascii() and p.isalpha() else self.pieces(whole))
        distinct = list(set().union(*pieces))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        decimal, bytes_of = self.decimal.__getitem__, self.bytes_of.__getitem__
        for p, own in zip(new, pieces, strict=True):
            joined = ids[own[0]] if len(own) == 1 else list(chain.from_iterable(map(ids.__getitem__, own)))
            self.memory[p] = array("i", joined).tobytes(), " ".join(map(decimal, joined)), b"".join(map(bytes_of, joined))

    def encode(self, text: str) -> list[int]:
        return _flat(next(iter(self.encode_batch([text])))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _flat(stretches: list[Stretch]) -> np.ndarray:
    return np.frombuffer(b"".join([ids for ids, _, _ in stretches]), np.int32)


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per Python worker; the file is read where the tokenizers are installed, on every executor."""
    return Vocabulary(path, pattern)


def _texts_in_parts(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in parts of about ``most`` bytes of text, so that a batch of long texts needs no more memory."""
    sizes = np.diff(np.frombuffer(batch.column("_text").cast(pa.large_string()).buffers()[1], np.int64)[batch.column("_text").offset :][: len(batch) + 1])
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(batch):
        yield batch.slice(start)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ``token_ids`` (array of int) and ``n_tokens`` of each text."""
    schema = T.StructType([*[df.schema[c] for c in carry], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        with lean(vocab.memory, vocab.older):
            for batch in batches:
                for part in _texts_in_parts(batch):
                    ids = [_flat(pieces) for pieces in vocab.encode_batch(part.column("_text").to_pylist())]
                    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns = [part.column(c) for c in carry] + [pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ship(df.sparkSession)
    return df.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``decoded``, the bytes that the ids stand for (null ids: no bytes)."""
    schema = T.StructType([*[df.schema[c] for c in carry], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        with lean(vocab.memory, vocab.older):
            for batch in batches:
                texts = [vocab.decode(x or []) for x in batch.column(len(carry)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(texts, pa.binary())], names=schema.names)

    ship(df.sparkSession)
    return df.select(*carry, F.col(ids).alias("_ids")).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encodes, decodes the ids, and returns the carried columns with ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by a space) and ``decoded_sha256`` (of the decoded bytes); ``with_ids`` adds
    ``token_ids``, which else never leave the worker."""
    schema = T.StructType([*[df.schema[c] for c in carry], *[T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))], *[T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        with lean(vocab.memory, vocab.older):
            for batch in batches:
                for part in _texts_in_parts(batch):
                    counts, ids_hash, bytes_hash, kept = [], [], [], []
                    for stretches in vocab.encode_batch(part.column("_text").to_pylist()):
                        decimal = " ".join([x for _, x, _ in stretches])
                        counts.append(decimal.count(" ") + 1 if decimal else 0)
                        if with_ids:
                            kept.append(_flat(stretches))
                        ids_hash.append(hashlib.sha256(decimal.encode()).hexdigest())
                        # Decoding joins what the ids stand for, so a stretch's ids are decoded once, as they are made.
                        bytes_hash.append(hashlib.sha256(b"".join([x for _, _, x in stretches])).hexdigest())
                    columns = [part.column(c) for c in carry] + [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string()), *[pa.array(kept, pa.list_(pa.int32()))] * with_ids]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ship(df.sparkSession)
    return df.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)
