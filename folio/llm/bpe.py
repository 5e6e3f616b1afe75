"""Byte-level BPE encoding and decoding by a given file of ranks.

A text falls into chunks that no pre-token crosses; the ids of a chunk are computed once while it is
remembered. Of a new chunk every pre-token is looked up in two tiers: a minimal perfect hash resolves
those that are vocabulary entries as a whole; the others are merged by a heap of ranked pairs over a
linked list of their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mix, slices

_WHITE = r"\t-\r \x85\xa0  -     　"
#: Cuts where the pre-token pattern always cuts: a run of other characters takes one space before it with it.
_CHUNK = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots, by a displacement for each bucket of about two keys.

    Buckets are placed from large to small by the first displacement that finds free slots for all keys;
    buckets of one key name their slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        h = self._hash(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        members = np.split(order, ends[:-1])
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.zeros(n, np.int64)
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) < 2:
                singles += [(b, own[0])] if len(own) else []
                continue
            for d in range(0, 1 << 24, 64):
                at = self._slots(h[own][None, :], np.arange(d, d + 64)[:, None])
                ordered = np.sort(at, axis=1)
                fits = ~taken[at].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if fits.any():
                    d, at = d + int(fits.argmax()), at[fits.argmax()]
                    break
            else:
                raise ValueError("no displacement found: are there equal keys?")
            taken[at], self.shift[b], self.slot_key[at] = True, d, own
        for (b, key), at in zip(singles, np.flatnonzero(~taken)):
            self.shift[b], self.slot_key[at] = -1 - at, key
        self.keys = [keys[i] for i in self.slot_key]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        return (mix(h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, items: list[bytes]) -> list[int]:
        """The key number of each item, or -1 for what is no key."""
        if not self.n or not items:
            return [-1] * len(items)
        h = self._hash(items)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0)))
        return [k if self.keys[s] == x else -1 for x, s, k in zip(items, slots.tolist(), self.slot_key[slots].tolist())]


class Vocabulary:
    """Ranks of byte strings as read from a file of base64 and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        keys = list(self.ranks)
        self.whole, self.rank_of = PerfectHash(keys), list(self.ranks.values())
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.memo = Memo(self._chunks, np.uint32, 700_000)
        self.merged: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry itself: the pair of lowest rank, the leftmost of equals, is merged first."""
        rank, pairs, n = self.ranks.get, self.pairs, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into another
        # A heap entry is one number: rank, then place, then where the right part ended when the pair was met.
        bits = (n + 1).bit_length()
        low, place = (1 << bits) - 1, 2 * bits
        heap = [(r << place) + (i << bits) + i + 2 for i, r in enumerate([pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, stop = top >> bits & low, top & low
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r << place) + (i << bits) + end[k])
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r << place) + (p << bits) + stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        split = [_PRE_TOKEN.findall(c) for c in chunks]
        distinct = list({p for pieces in split for p in pieces})
        raw = [p.encode() for p in distinct]
        if len(self.merged) > 400_000:
            self.merged.clear()
        ids = {}
        for p, b, k in zip(distinct, raw, self.whole.find(raw)):
            if k >= 0:
                ids[p] = [self.rank_of[k]]
            elif (known := self.merged.get(b)) is not None:
                ids[p] = known
            else:
                ids[p] = self.merge(b)
                if len(b) <= 64:
                    self.merged[b] = ids[p]
        return [[i for p in pieces for i in ids[p]] for pieces in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        out: list[np.ndarray] = []
        for lo, hi in slices([len(t) for t in texts]):
            chunks = [_CHUNK.findall(t) for t in texts[lo:hi]]
            ids, lengths = self.memo.values([c for some in chunks for c in some])
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(some) for some in chunks])]
            out += np.split(ids, ends[:-1])
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        chunks = [_CHUNK.findall(t) for t in texts]
        at = self.memo.at([c for some in chunks for c in some])
        ends = np.concatenate([[0], np.cumsum(self.memo.length[at])])[np.cumsum([0, *map(len, chunks)])]
        return np.diff(ends).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    return Vocabulary(path)


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null text counts as empty and has no ids. Rows are independent, repeated ids too."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in slices([len(t) for t in texts], 4 << 20):
                ids = coder.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return _read(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids give empty bytes. An id that the vocabulary lacks is an error."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([coder.decode(x or ()) for x in some.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, and decoded again from the ids, in one pass.

    Null text counts as empty. Rows are independent, so repeated ids give repeated rows; other columns are not read.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _read(documents, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _read(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
