"""Ranked lexical search over inverted treaps: a binary tree for each term, by document, with the largest impact on top.

Documents are dealt into shards as they are read. Within a shard every term has a treap over the documents that
hold it: to the left of a node stand the smaller ids, and below it no impact is larger. A search walks the treaps of
all terms of an item at once. An interval of documents holds the topmost node of each treap within it; the sum of
their impacts is what no document of the interval can exceed. Where that cannot enter the k best, all the trees below
are left unread; else the document on top of the largest part is scored and parts the interval in two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 10
#: Documents of a shard, and terms with repeats from which on a shard takes no further document.
DOCS, TERMS = 8192, 1 << 22
#: Bytes of a long text that are looked at at once.
STRETCH = 1 << 22
#: Distinct terms asked for, up to which an index of these terms alone is built; of more, all terms are indexed.
ASKED = 1_000_000
#: Terms of items that are sent to all tasks at once; more items are searched for in further rounds.
ROUND = 500_000
#: Shards that are searched first, for a score that the others have to reach.
FIRST = 4
#: Intervals that are parted at once, at first and at most.
STEP, MOST = 32, 1024
#: Terms are runs of ASCII digits and letters and of all that is not ASCII; only A-Z are lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_POSTINGS = "shard long, n_docs long, n_terms long, ids binary, lengths binary, terms array<string>, df array<int>, docs binary, tf binary"
_INDEX = "shard long, ids binary, terms array<string>, df array<int>, docs binary, impact binary, left binary, right binary, root binary"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size: a long text is taken in stretches that end between terms."""
    raw, at = raw.translate(_LETTERS), 0
    while at < len(raw):
        end = raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class _Postings:
    """Gathers the documents of one shard."""

    def __init__(self, asked: dict[bytes, int] | None):
        self.vocabulary = {} if asked is None else asked
        self.open = asked is None
        self.ids, self.lengths, self.term, self.tf, self.count, self.total = [], [], [], [], [], 0

    def add(self, doc_id: int, raw: bytes) -> None:
        n, found = 0, []
        for part in terms_of(raw):
            n += len(part)
            if self.open:
                for t in set(part).difference(self.vocabulary):
                    self.vocabulary[t] = len(self.vocabulary)
            found.append(np.fromiter(map(self.vocabulary.get, part, repeat(-1)), np.int32, len(part)))
        if not n:
            return
        found = np.concatenate(found)
        term, tf = np.unique(found[found >= 0], return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.term.append(term)
        self.tf.append(tf)
        self.count.append(len(term))
        self.total += n

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.total >= TERMS

    def row(self, shard: int) -> dict:
        """Documents in the order of their ids, postings by term and document."""
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc, term, tf = np.repeat(place, self.count), np.concatenate(self.term).astype(np.int64), np.concatenate(self.tf)
        at = np.argsort(term * len(ids) + doc)
        held, df = np.unique(term, return_counts=True)
        names = [*self.vocabulary]
        return {
            "shard": shard, "n_docs": len(ids), "n_terms": self.total, "ids": ids[order].tobytes(), "lengths": lengths[order].tobytes(),
            "terms": [names[t].decode("utf-8", "replace") for t in held.tolist()], "df": df.tolist(), "docs": doc[at].astype(np.uint16).tobytes(), "tf": tf[at].astype(np.int32).tobytes(),
        }


def _rows(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))]))


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, asked = TaskContext.get().partitionId() << 32, shared.value if shared else None
        held = _Postings(asked)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.add(doc_id, raw.as_py() or b"")
                if held.full():
                    yield _rows(_POSTINGS, [held.row(shard)])
                    shard, held = shard + 1, _Postings(asked)
        if held.ids:
            yield _rows(_POSTINGS, [held.row(shard)])

    return run


def treaps(doc: np.ndarray, priority: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, root) of the treaps of many terms, as positions in the postings; len(doc) stands for none.

    doc rises within each term, whose priorities differ. The parent of a posting is the smaller one of the nearest
    larger ones on its two sides; these are found by jumps over what is smaller, for all postings at once.
    """
    n = len(doc)
    start = np.cumsum(df) - df
    above = np.append(priority, np.iinfo(np.int64).max)
    before, after = np.arange(-1, n), np.arange(1, n + 2)
    before[start[df > 0]], after[(start + df - 1)[df > 0]] = n, n
    before[n] = after[n] = n
    for near in (before, after):
        at = np.flatnonzero(above[near] < above)
        while len(at):
            near[at] = near[near[at]]
            at = at[above[near[at]] < above[at]]
    left, right, root = np.full(n + 1, n), np.full(n + 1, n), np.full(len(df), n)
    me = np.arange(n)
    before, after = before[:n], after[:n]
    up = np.where(above[before] < above[after], before, after)
    top, below_after = up == n, (up == after) & (up < n)
    left[after[below_after]] = me[below_after]
    below_before = ~top & ~below_after
    right[before[below_before]] = me[below_before]
    root[np.repeat(np.arange(len(df)), df)[top]] = me[top]
    return left, right, root


def _treap_rows(n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                doc, tf, df = np.frombuffer(row["docs"], np.uint16).astype(np.int64), np.frombuffer(row["tf"], np.int32).astype(np.int64), np.array(row["df"], np.int64)
                m = 10 + (90 * np.frombuffer(row["lengths"], np.int64) * n) // total
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                # Equal impacts are ordered by scattered numbers, each document's own, so that trees stay low.
                left, right, root = treaps(doc, (impact << 16) | ((doc * 40503) & 0xFFFF), df)
                binary = {"impact": impact, "left": left, "right": right, "root": root}
                yield _rows(_INDEX, [{k: row[k] for k in ("shard", "ids", "terms", "df", "docs")} | {k: x.astype(np.int32).tobytes() for k, x in binary.items()}])

    return run


class Shard:
    """The treaps of one shard."""

    def __init__(self, row: dict):
        self.ids, df = np.frombuffer(row["ids"], np.int64), np.array(row["df"], np.int64)
        doc = np.frombuffer(row["docs"], np.uint16).astype(np.int64)
        self.none, self.n = len(doc), len(self.ids)
        self.doc = np.append(doc, -1)
        self.impact = np.append(np.frombuffer(row["impact"], np.int32).astype(np.int64), 0)
        self.left, self.right, self.root = (np.frombuffer(row[k], np.int32) for k in ("left", "right", "root"))
        self.keys = np.append(np.repeat(np.arange(len(df)), df) * self.n + doc, np.iinfo(np.int64).max)
        self.term = {t: i for i, t in enumerate(row["terms"])}

    def score(self, at: np.ndarray, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of documents, for terms `at` of weights w."""
        wanted = at * self.n + doc[:, None]
        place = np.searchsorted(self.keys, wanted)
        return (np.where(self.keys[place] == wanted, self.impact[place], 0) * w).sum(1)

    def settle(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Move nodes (row, term) down their trees to the topmost that lies between lo and hi of its row; both are left out."""
        flat, row = node.reshape(-1), np.repeat(np.arange(len(node)), node.shape[1])
        at = np.flatnonzero(flat != self.none)
        while len(at):
            x, r = flat[at], row[at]
            doc = self.doc[x]
            high = doc >= hi[r]
            move = high | (doc <= lo[r])
            at, x = at[move], x[move]
            flat[at] = np.where(high[move], self.left[x], self.right[x])
            at = at[flat[at] != self.none]

    def best(self, at: np.ndarray, w: np.ndarray, k: int, bar: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, how many were scored) of at most k that can be among the k best for terms `at` of weights w; best first, equal ones by id.

        `bar` is the score and id of a k-th best document known before: what comes after it is left out.
        """
        node, lo, hi = self.root[at][None, :].astype(np.int64), np.array([-1]), np.array([self.n])
        bound, step, scored = (self.impact[node] * w).sum(1), STEP, 0
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(bound):
            pick = np.argpartition(-bound, step)[:step] if len(bound) > step else np.arange(len(bound))
            step = min(2 * step, MOST)
            v, a, b = node[pick], lo[pick], hi[pick]
            doc = self.doc[v[np.arange(len(v)), (self.impact[v] * w).argmax(1)]]
            docs, scores = np.append(docs, doc), np.append(scores, self.score(at, w, doc))
            scored += len(doc)
            good = scores > 0
            if bar:
                good &= (scores > bar[0]) | ((scores == bar[0]) & (self.ids[docs] <= bar[1]))
            docs, scores = docs[good], scores[good]
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(docs) == k:
                bar = (int(scores[-1]), int(self.ids[docs[-1]]))
            keep = np.ones(len(bound), bool)
            keep[pick] = False
            v, a, b = np.concatenate([v, v]), np.concatenate([a, doc]), np.concatenate([doc, b])
            self.settle(v, a, b)
            node, lo, hi = np.concatenate([node[keep], v]), np.concatenate([lo[keep], a]), np.concatenate([hi[keep], b])
            bound = np.concatenate([bound[keep], (self.impact[v] * w).sum(1)])
            keep = bound > 0
            if bar:
                keep &= (bound > bar[0]) | ((bound == bar[0]) & (self.ids[np.minimum(lo + 1, self.n - 1)] <= bar[1]))
            node, lo, hi, bound = node[keep], lo[keep], hi[keep], bound[keep]
        return docs, scores, scored


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)) for part in terms_of(raw.as_py() or b"") for t in set(part)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t.decode("utf-8", "replace") for _, t in found], pa.string())], ["item_id", "term"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once. Rows of one id are one item; rows without id or text have no terms."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return rows.mapInArrow(_items, "item_id long, term string").distinct()


def postings(documents: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard: its documents and, by term and document, how often it occurs. With `asked` (term), at most ASKED of them, only of these terms."""
    shared = None
    if asked is not None and asked.count() <= ASKED:
        shared = documents.sparkSession.sparkContext.broadcast({r["term"].encode(): i for i, r in enumerate(asked.orderBy("term").collect())})
    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return rows.mapInArrow(_postings(shared), _POSTINGS)


def index(documents: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(treaps, one row a shard; term, df, w of all terms). Impacts rest on the number and length of all documents, so these are counted first."""
    base = written(postings(documents, asked, id_col, text_col))
    n, total = base.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = base.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weights = df.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long"))
    return written(base.mapInArrow(_treap_rows(n, max(total, 1)), _INDEX)), weights


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                out = []
                for item, (terms, weights, bar) in shared.value.items():
                    known = [(shard.term[t], w) for t, w in zip(terms, weights) if t in shard.term]
                    if known:
                        at, w = np.array(known, np.int64).T
                        docs, scores, _ = shard.best(at, w, k, bar)
                        out.append((np.full(len(docs), item), shard.ids[docs], scores))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item; fewer where fewer score above 0.

    Equal scores go to the smaller doc_id. Rows that repeat an id are documents of their own, with ranks of their own;
    rows without an id take no part, not in counts either. Null and empty texts have no terms. Items: see item_terms.
    An item none of whose terms occurs has no rows; so has an empty table. Other columns are not looked at.

    A few shards, chosen by hash, are searched first: the k-th best score found there is what all others must reach.
    """
    wanted = written(item_terms(items, item_col, item_text_col))
    table, weights = index(documents, wanted.select("term").distinct(), id_col, text_col)
    rounds = max(1, -(-wanted.count() // ROUND))
    weighted = written(wanted.join(weights, "term").withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds)).cast("int")))
    first = [r["shard"] for r in table.select("shard").orderBy(F.xxhash64("shard"), "shard").limit(FIRST + 1).collect()]
    out = None
    for r in range(rounds):
        asked = {}
        for row in weighted.where(F.col("round") == r).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).collect():
            asked[row["item_id"]] = ([t["term"] for t in row["t"]], [t["w"] for t in row["t"]], None)
        if len(first) > FIRST:
            seen = table.where(F.col("shard").isin(first[:FIRST])).mapInArrow(_search(_sent(table, asked), k), "item_id long, doc_id long, score long")
            for row in _ranked(seen, k).where(F.col("rank") == k).collect():
                asked[row["item_id"]] = (*asked[row["item_id"]][:2], (row["score"], row["doc_id"]))
        found = table.mapInArrow(_search(_sent(table, asked), k), "item_id long, doc_id long, score long")
        out = found if out is None else out.union(found)
    return _ranked(out, k)


def _sent(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)
