"""Exact deduplication by Grace hashing: partition, spill, and compare whole contents in open-addressing tables.

1. Build side. Each task folds the equal texts of a chunk of its input into one record, so a group of
   copies sends at most one record from each chunk, however large it is. A chunk ends when its distinct texts
   reach FOLD_BYTES, so copies make it longer.
2. Records are shuffled by a hash of their content. A partition that does not fit the table's memory is
   split by further bits of the hash into spill files in the task's own temporary folder, again and again,
   until each bucket fits. The files go when the task ends; a lost task starts anew from the shuffle.
3. A bucket's open-addressing table compares complete contents, so hash collisions never merge texts.
4. The class of each record goes back to the rows of its chunk by a join on (chunk, slot); a key has the rows of
   one task at most.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, slices, written

#: Rows read at once; bytes of distinct texts that a task folds before it sends them on.
CHUNK_ROWS, FOLD_BYTES = 4096, 32 << 20
#: Bytes of content that one open-addressing table holds.
TABLE_BYTES = 32 << 20
FAN_OUT = 16
#: Ids that go are sent to all tasks up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 1_000_000
MAX_DEPTH = 12
_SPACES = re.compile(SPACES)


def normalised(text: str | None) -> bytes:
    """The text with every run of ASCII white space as one space, in UTF-8; null is empty."""
    return _SPACES.sub(" ", text).encode() if text else b""


class ContentTable:
    """Open addressing with linear probing; a slot's content is compared in full."""

    def __init__(self, capacity: int = 1024):
        self.slots: list[int] = [-1] * capacity
        self.contents: list[bytes] = []
        self.hashes: list[int] = []

    def find(self, h: int, content: bytes) -> int:
        """The number of content, which is added if new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i
            at = (at + 1) & mask
        self.slots[at] = i = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return i

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


_FOLDED = "doc_id long, chunk string, slot int, h long, content binary, least long, copies long, sha binary"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: members (doc_id, chunk, slot, sha) and, for each distinct text of a chunk, a record (chunk, slot, h, content, least id, copies)."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    seen: dict[bytes, int] = {}
    sha: list[bytes] = []
    least: list[int | None] = []
    copies: list[int] = []
    size = 0

    def records() -> Iterator[pa.RecordBatch]:
        contents = list(seen)
        for a, b in slices([len(t) for t in contents], 4 << 20):
            h = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in contents[a:b]]
            yield _rows(b - a, chunk=[f"{task}-{number}"] * (b - a), slot=range(a, b), h=h, content=contents[a:b], least=least[a:b], copies=copies[a:b])

    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(lo, CHUNK_ROWS)
            ids, slots = part.column("doc_id").to_pylist(), []
            for i, text in zip(ids, part.column("text").to_pylist()):
                t = normalised(text)
                s = seen.setdefault(t, len(sha))
                if s == len(sha):
                    size += len(t) + 200
                    sha.append(hashlib.sha256(t).digest())
                    least.append(None)
                    copies.append(0)
                slots.append(s)
                copies[s] += 1
                if i is not None and (least[s] is None or i < least[s]):
                    least[s] = i
            yield _rows(len(ids), doc_id=ids, chunk=[f"{task}-{number}"] * len(ids), slot=slots, sha=[sha[s] for s in slots])
            if size >= FOLD_BYTES:
                yield from records()
                number, size = number + 1, 0
                for held in (seen, sha, least, copies):
                    held.clear()
    yield from records()


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "chunk": pa.string(), "slot": pa.int32(), "h": pa.int64(), "content": pa.binary(), "least": pa.int64(), "copies": pa.int64(), "sha": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kind) for c, kind in kinds.items()], schema=pa.schema(list(kinds.items())))


_CLASSES = "chunk string, slot int, keep_id long, group_size long"


def _resolved(refs: list[tuple], contents: int) -> Iterator[pa.RecordBatch]:
    """The class of each record (chunk, slot, content number, least id, copies) of a bucket that fits in memory."""
    least, size = [None] * contents, [0] * contents
    for _, _, i, low, copies in refs:
        size[i] += copies
        if low is not None and (least[i] is None or low < least[i]):
            least[i] = low
    for lo in range(0, len(refs), 10_000):
        some = refs[lo : lo + 10_000]
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([r[0] for r in some], pa.string()), "slot": pa.array([r[1] for r in some], pa.int32()), "keep_id": pa.array([least[r[2]] for r in some], pa.int64()), "group_size": pa.array([size[r[2]] for r in some], pa.int64())}
        )


def _bucket(stream: Iterator[tuple], depth: int, folder: str, most: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Resolve a stream of records: in memory if its distinct contents fit the table, else bucket by bucket through spill files."""
    table, refs, total = ContentTable(), [], 0
    for chunk, slot, h, content, least, copies in stream:
        known = len(table.contents)
        refs.append((chunk, slot, i := table.find(h, content), least, copies))
        total += 120 + (len(content) + 200) * (i == known)
        if total > most and len(table.contents) > 1 and depth < MAX_DEPTH:
            break
    else:
        yield from _resolved(refs, len(table.contents))
        return
    paths = [os.path.join(folder, f"{depth}-{k}-{os.urandom(4).hex()}") for k in range(FAN_OUT)]
    files = [open(p, "wb") for p in paths]  # noqa: SIM115
    try:
        held = ((chunk, slot, table.hashes[i], table.contents[i], least, copies) for chunk, slot, i, least, copies in refs)
        for source in (held, stream):
            for record in source:
                pickle.dump(record, files[(record[2] >> (4 * depth)) % FAN_OUT], 5)
        del held, table, refs
    finally:
        for f in files:
            f.close()
    for p in paths:
        yield from _bucket(_spilled(p), depth + 1, folder, most)
        os.remove(p)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _grace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                yield from zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns))

    with tempfile.TemporaryDirectory(prefix="folio-spill-") as folder:
        yield from _bucket(records(), 0, folder)


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of ASCII white space became one space; null counts as
    empty, and so do not differ. keep_id is the smallest id of the group, null if the group has no ids.
    Of rows that repeat the smallest id all are `kept`: rows cannot be told apart by anything else.
    A row without an id is kept only where no row of its group has one. Other columns are not read.
    An empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folded = written(docs.mapInArrow(_folded, _FOLDED))
    records = folded.where("content is not null").select("chunk", "slot", "h", "content", "least", "copies")
    classes = records.repartition(F.col("h")).mapInArrow(_grace, _CLASSES)
    members = folded.where("content is null").select("doc_id", "chunk", "slot", "sha")
    out = members.join(classes, ["chunk", "slot"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents, with all their columns, of which exact_dedup keeps one for each text.

    Of rows that repeat the id that stays, with one text, one stays. Names of columns may be any. Where no id repeats
    or is null, rows that go are known by their ids and no text is moved while those are few.
    """
    classes = written(exact_dedup(documents, id_col, text_col))
    own = F.col(id_col).cast("long")
    if classes.groupBy("doc_id").agg(F.count("*").alias("c")).where("doc_id is null or c > 1").isEmpty():
        gone = fresh(documents, "gone")
        ids = classes.where("not kept").select(F.col("doc_id").alias(gone))
        return documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, own == F.col(gone), "left_anti")
    i, sha, id_, sha_ = (fresh(documents, name) for name in ("kept_id", "kept_sha", "own_id", "own_sha"))
    stay = classes.where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(sha)).distinct()
    spaced = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")
    marked = documents.withColumns({id_: own, sha_: F.sha2(spaced.cast("binary"), 256)})
    kept = marked.join(stay, F.col(id_).eqNullSafe(F.col(i)) & (F.col(sha_) == F.col(sha)), "left_semi")
    return kept.dropDuplicates([id_, sha_]).drop(id_, sha_)
