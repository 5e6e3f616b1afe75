"""Packing documents into sequences of fixed length along a Hilbert curve.

1. One pass tokenises each document (ids and one end id) and projects its hashed bag of tokens to four
   dimensions; the cell of a 4-d grid gives the Hilbert key. The ids go to a table in the shared folder.
2. Slim rows (key, row, length) are range-sorted by key; running sums within each range partition, and the
   totals of the partitions before it, give every document its place on one line of tokens. What the
   driver sees is one number for each partition.
3. The line is cut every `width` ids. Neighbours on the curve share sequences, and only the last sequence
   can need padding.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mix, ragged, slices, written

WIDTH = 2048
END_ID = 1
DIMENSIONS, BITS, BUCKETS = 4, 12, 1024
#: White space of the tokenizer, at which it always cuts; Python's str.split also cuts at 0x1C to 0x1F.
_WHITE = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Between a letter and a sign other than an apostrophe the tokenizer cuts as at a space.
_SIGNS = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[.,;:!?*$%#&])")
#: Letters that Python lowers otherwise than one by one, as the tokenizer does.
_CASE = re.compile("[\u0130\u03a3]")


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts by a tokenizer file that drops white space; a chunk between white space is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self._chunks, np.uint32, 400_000)
        #: A sign that is one token between spaces. New chunks without it are encoded many at a time, with it between them.
        self.between = next((c for c in "|~^" if len(self._ids([c])[0]) == 1), None)
        self.between_id = self._ids([self.between])[0][0] if self.between else -1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list:
        joined = [i for i, c in enumerate(chunks) if self.between and self.between not in c]
        out: list = [None] * len(chunks)
        for lo in range(0, len(joined), 2048):
            some = joined[lo : lo + 2048]
            ids = np.array(self._ids([f" {self.between} ".join(chunks[i] for i in some)])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) != len(some) - 1:  # never seen: a chunk has the sign's id without the sign
                found = self._ids([chunks[i] for i in some])
            else:
                found = [ids[a:b] for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)])]
            for i, x in zip(some, found):
                out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(rest), 4096):
            for i, x in zip(rest[lo : lo + 4096], self._ids([chunks[i] for i in rest[lo : lo + 4096]])):
                out[i] = x
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, the number of ids of each text)."""
        texts = [t.lower() if t.isascii() or unicodedata.is_normalized("NFC", t) and not _CASE.search(t) else t for t in texts]
        texts = [_SIGNS.sub(" ", t) for t in texts]
        chunks = [_CHUNK.findall(t) if _ODD.search(t) else t.split() for t in texts]
        ids, lengths = self.memo.values([c for some in chunks for c in some])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(some) for some in chunks])] if chunks else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(10).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integers below 2 ** bits (Skilling's transposition, for all rows at once)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros(len(points), np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ t) >> bit) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as runs of token ids. Equal documents get equal keys."""
    bucket = (mix(ids.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    sums = np.stack([np.bincount(doc, _projection()[bucket, d], len(lengths)) for d in range(DIMENSIONS)], axis=1)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    grid = np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(grid)


_CODED = "row long, doc_id long, key long, n long, ids binary"


def coded(documents: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """(row, doc_id, key, n, ids) of every row; ids are little-endian, of 16 bits if the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, row = tokenizer(path), TaskContext.get().partitionId() << 40
        kind = _id_type(coder)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in slices([len(t) for t in texts]):
                ids, lengths = coder.encode(texts[lo:hi])
                ends = np.cumsum(lengths)
                keys = curve_keys(ids, lengths)
                own = np.split(ids.astype(kind), ends[:-1])
                data = [np.append(x, kind(end_id)).tobytes() for x in own]
                rows = pa.array(np.arange(row, row + hi - lo))
                row += hi - lo
                yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").slice(lo, hi - lo), pa.array(keys), pa.array(lengths + 1), pa.array(data, pa.binary())], ["row", "doc_id", "key", "n", "ids"])

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, _CODED)


def _id_type(coder: WordTokenizer):
    return np.uint16 if coder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for pdf in batches:
        n = pdf["n"].to_numpy(np.int64)
        ends = total + np.cumsum(n)
        if len(n):
            total = int(ends[-1])
        yield pd.DataFrame({"row": pdf["row"], "part": np.int32(part), "at": ends - n, "end": ends})


def places(lengths: DataFrame) -> DataFrame:
    """(row, place): where each row (row, key, n) starts on one line, in order of key and row."""
    sorted_rows = lengths.select("row", "key", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    local = written(sorted_rows.mapInPandas(_running, "row long, part int, at long, end long"))
    totals = sorted((r["part"], r["total"]) for r in local.groupBy("part").agg(F.max("end").alias("total")).collect())  # one row for each partition
    starts, before = [], 0
    for part, total in totals:
        starts.append((part, before))
        before += total
    base = local.sparkSession.createDataFrame(starts, "part int, base long")
    return local.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("at")).alias("place"))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids.

    Null text counts as empty: such a document is its end id alone. Repeated ids and repeated rows are packed
    each on its own; a null id stays null. Documents of any length are cut where a sequence is full. Sequences
    are full but the last one. Other columns are not read. An empty table gives an empty result.
    """
    path = path or default_tokenizer()
    table = written(coded(documents, id_col, text_col, path, end_id))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(tokenizer(path))
        for batch in batches:
            n, place = batch.column("n").to_numpy(), batch.column("place").to_numpy()
            first = place // width
            pieces = (place + n - 1) // width - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = first[doc] + ragged(np.zeros(len(n), np.int64), pieces)
            lo = np.maximum(sequence * width, place[doc])
            hi = np.minimum((sequence + 1) * width, (place + n)[doc])
            start, data = lo - place[doc], batch.column("ids").to_pylist()
            wide, at = [], -1
            for d, a, length in zip(doc.tolist(), start.tolist(), (hi - lo).tolist()):
                if d != at:
                    ids, at = np.frombuffer(data[d], kind).astype("<u4"), d
                wide.append(ids[a : a + length])
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(hi - lo), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(lo - sequence * width)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype(np.int32) for x in wide], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = table.join(places(table), "row").select("doc_id", "n", "place", "ids")
    return placed.mapInArrow(cut, _PIECES + ", ids array<int>" * with_ids)
