"""Token counts that follow edits: a tree over each document's pre-token segments, of which edits re-encode only leaves.

A text can be cut wherever white space follows another character: no pre-token crosses that place, whatever
stands around it. Leaves are runs of such segments; inner nodes hold sums of characters and tokens. An edit
re-encodes the leaves that hold the characters just before and just after it, and those between; the cuts at
both ends lie outside what it changed. Then the sums above are updated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _WHITE, default_vocabulary, vocabulary
from .common import slices, written

#: Characters of a leaf, about; a leaf that grows beyond SPLIT times that is cut again.
LEAF, SPLIT = 128, 8
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])")


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces of about `size` characters, cut only where white space follows another character."""
    out, start = [], 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


#: Gives the number of tokens of each text.
Count = Callable[[list[str]], list[int]]


class SegmentTree:
    """Sums of characters and tokens over the leaves of a text. Leaf i is node `base + i` of the heap."""

    def __init__(self, texts: list[str], tokens: list[int]):
        self.reencoded = 0
        self._build(texts, tokens)

    @classmethod
    def of(cls, texts: list[str], count: Count) -> list[SegmentTree]:
        """The trees of many texts, whose leaves are counted at once."""
        leaves = [leaves_of(t) for t in texts]
        counts = iter(count([leaf for some in leaves for leaf in some]))
        return [cls(some, [next(counts) for _ in some]) for some in leaves]

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        self.base = 1 << max(0, len(texts) - 1).bit_length()
        self.texts = texts + [""] * (self.base - len(texts))
        pad = [0] * (self.base - len(texts))
        self.chars = [0] * self.base + [len(t) for t in texts] + pad
        self.tokens = [0] * self.base + tokens + pad
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds character `at`."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.base, start

    def opened(self, start: int, length: int, replacement: str) -> tuple[int, int, list[str]]:
        """(first leaf, last leaf, the text that stands for them, in pieces) after `length` characters from `start` on are replaced; both are cut to what the text has."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        stop = min(start + max(length, 0), n)
        first, begin = self._leaf(max(start - 1, 0)) if n else (0, 0)
        last, end = self._leaf(min(stop, n - 1)) if n else (0, 0)
        old = "".join(self.texts[first : last + 1])
        return first, last, leaves_of(old[: start - begin] + replacement + old[stop - begin :])

    def closed(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """Put the pieces and their tokens in place of the leaves, and update the sums above."""
        new = "".join(pieces)
        self.reencoded += len(new)
        if len(pieces) <= last - first + 1:
            put = [(p, c) for p, c in zip(pieces, counts)]
            put += [("", 0)] * (last - first + 1 - len(put))
        elif len(new) <= SPLIT * LEAF:
            put = [(new, sum(counts)), *[("", 0)] * (last - first)]
        else:
            leaves = list(zip(self.texts, self.tokens[self.base :]))
            leaves[first : last + 1] = zip(pieces, counts)
            leaves = [(t, c) for t, c in leaves if t] or [("", 0)]
            self._build([t for t, _ in leaves], [c for _, c in leaves])
            return
        touched = set()
        for leaf, (text, tokens) in zip(range(first, last + 1), put):
            self.texts[leaf], self.chars[self.base + leaf], self.tokens[self.base + leaf] = text, len(text), tokens
            touched.add((self.base + leaf) // 2)
        while touched and touched != {0}:
            for node in touched:
                self._sum(node)
            touched = {node // 2 for node in touched}

    def edit(self, start: int, length: int, replacement: str, count: Count) -> None:
        first, last, pieces = self.opened(start, length, replacement)
        self.closed(first, last, pieces, count(pieces))

    def text(self) -> str:
        return "".join(self.texts)


def edit_all(trees: list[SegmentTree], edits: list[list[tuple]], count: Count) -> None:
    """Each tree's edits one after the other; the next edits of all trees are counted at once."""
    for turn in range(max(map(len, edits), default=0)):
        at = [i for i, own in enumerate(edits) if turn < len(own)]
        opened = [trees[i].opened(*edits[i][turn]) for i in at]
        counts = iter(count([p for _, _, pieces in opened for p in pieces]))
        for i, (first, last, pieces) in zip(at, opened):
            trees[i].closed(first, last, pieces, [next(counts) for _ in pieces])


_OUT = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_reencoded long"


#: Rows of one id above which they are dealt to groups of about so many, each with the id's edits.
MANY = 1000
#: Ids with more rows are sent to all tasks up to this many, else joined by shuffle.
BROADCAST_IDS = 1_000_000


def edited_token_counts(documents: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: tokens before, edits, tokens and characters after them, characters that edits re-encoded.

    edits has (doc_id, seq, start, length, replacement): characters of the text as the edits before left it, in
    order of seq, then of the other columns. Null text counts as empty, null replacement too, null start and length as 0; places outside the text are
    cut to it. Edits of ids that documents lacks and rows with a null id in either table are left out. Where documents
    repeats an id each of its rows is edited alike. A document's edits depend on each other and so run in one task, one after the other, in the
    memory of one document. A text without a place to cut is one leaf, which each edit encodes whole. Empty tables give empty results.

    Texts are moved once, to where the edits of their ids are. No tree is kept from one call to the next: a call reads texts anyway,
    and a stored tree (the leaves with their texts) would be as large as they are.
    """
    path = path or default_vocabulary()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    then = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), F.coalesce(F.col("replacement").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    zero = F.lit(0).cast("long")
    many = documents.select(F.col(id_col).cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > MANY)
    many = written(many.select("doc_id", F.ceil(F.col("c") / MANY).alias("parts")))
    docs = docs.withColumn("part", zero)
    if (found := many.count()):
        few = F.broadcast(many) if found <= BROADCAST_IDS else many
        # Rows of such an id are numbered once and written, so a task that is run again deals them alike.
        hot = written(docs.drop("part").join(few, "doc_id").withColumn("number", F.monotonically_increasing_id()))
        docs = docs.join(few, "doc_id", "left_anti").unionByName(hot.select("doc_id", "text", F.pmod(F.xxhash64("number"), "parts").alias("part")))
        then = then.join(few, "doc_id", "left").withColumn("part", F.explode(F.sequence(zero, F.coalesce(F.col("parts") - 1, zero)))).drop("parts")
    # The edits of an id come first and are held; then each of its texts passes.
    rows = then.union(docs.select("doc_id", "part", F.lit(1).alias("kind"), zero, zero, zero, "text"))
    rows = rows.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "kind", "seq", "start", "length", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary(path).counts
        names = [c.split()[0] for c in _OUT.split(", ")]
        group, own = None, []
        for batch in batches:
            docs: list[tuple[int, list[tuple], str]] = []
            for d, p, kind, start, length, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "kind", "start", "length", "text"))):
                if (d, p) != group:
                    group, own = (d, p), []
                if kind == 0:
                    own.append((start, length, text))
                else:
                    docs.append((d, own, text))
            for lo, hi in slices([len(x[2]) for x in docs]):
                some = docs[lo:hi]
                trees = SegmentTree.of([x[2] for x in some], count)
                before = [t.tokens[1] for t in trees]
                edit_all(trees, [x[1] for x in some], count)
                columns = [[x[0] for x in some], before, [len(x[1]) for x in some], [t.tokens[1] for t in trees], [t.chars[1] for t in trees], [t.reencoded for t in trees]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return rows.mapInArrow(run, _OUT)


def sample_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Three edits of each id: an insertion at a third, a deletion at the middle, a replacement at the end. Where an id repeats its longest text counts; null ids have none."""
    n = F.col("n")
    each = F.array(
        F.struct(F.lit(1).alias("seq"), F.floor(n / 3).alias("start"), F.lit(0).alias("length"), F.lit(" it's 2024\n").alias("replacement")),
        F.struct(F.lit(2).alias("seq"), F.floor(n / 2).alias("start"), F.lit(12).alias("length"), F.lit("").alias("replacement")),
        F.struct(F.lit(3).alias("seq"), F.greatest(n - 6, F.lit(0)).alias("start"), F.lit(5).alias("length"), F.lit("é  fin.").alias("replacement")),
    )
    longest = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    return longest.select("doc_id", F.inline(each))
