"""Helpers shared by the training-data operators: words, shingles, scratch tables, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"
SHINGLE = 5
MASK = (1 << 64) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of a whole text; None has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words the whole sequence counts as one."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _MULTIPLIER + h[j : len(h) - width + 1 + j]
    return distinct(mix(out))


def slices(sizes: Sequence[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes sum to about `most`; a larger row stands alone. Bounds what a task expands at once."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of many ranges, one after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    return out + np.arange(len(out))


class Memo:
    """Results of a function of strings, kept for the strings met before, as ranges of one array.

    compute(list of new strings) gives one sequence of numbers for each. The memory is bounded: beyond
    `most` kept strings or numbers it starts afresh. Results never depend on what is kept.
    """

    def __init__(self, compute: Callable[[list], list], dtype, most: int = 250_000):
        self.compute, self.dtype, self.most = compute, dtype, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.start, self.length, self.data, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.dtype), 0

    def at(self, items: list) -> np.ndarray:
        """Positions of items in start and length; valid until the next call."""
        new = list(set(items).difference(self.index))
        if len(self.index) + len(new) > self.most or self.used > 8 * self.most:
            self._clear()
            new = list(set(items))
        if new:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, items), np.int64, len(items))

    def _add(self, new: list) -> None:
        found, n = self.compute(new), len(self.index)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total, end = int(lengths.sum()), n + len(new)
        if end > len(self.start):
            grown = max(end, 2 * len(self.start))
            self.start, self.length = np.resize(self.start, grown), np.resize(self.length, grown)
        if self.used + total > len(self.data):
            self.data = np.resize(self.data, max(self.used + total, 2 * len(self.data)))
        self.start[n:end], self.length[n:end] = self.used + np.cumsum(lengths) - lengths, lengths
        if total:
            arrays = all(isinstance(x, np.ndarray) for x in found)
            self.data[self.used : self.used + total] = np.concatenate(found) if arrays else np.fromiter(chain.from_iterable(found), self.dtype, total)
        self.used += total
        self.index.update(zip(new, range(n, end)))

    def values(self, items: list) -> tuple[np.ndarray, np.ndarray]:
        """(all numbers in order, how many each item has)."""
        at = self.at(items)
        lengths = self.length[at]
        return self.data[ragged(self.start[at], lengths)], lengths


def held_out(id_col: str = "doc_id"):
    """True for the fifth of rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y): at most `rows` labelled documents outside the held-out fifth, half of them of each class as far as there are.

    The sample is the first `rows` in order of a hash of the id. Null labels and ids whose labels differ are left out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    halves = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows // 2) for y in (0, 1)]
    chosen = F.broadcast(halves[0].union(halves[1]))  # at most `rows` rows of two numbers
    docs = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.join(chosen, "_id").select("text", F.col("_y").alias("y"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir, or in a session without one (tests) a new local folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folio-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read by many, and safe against lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/folio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (out, path)
    return out


#: Tables of this session by the identity of their frames, which are held so that no identity is used twice.
_TABLES: dict[int, tuple[DataFrame, str]] = {}


def released(*tables: DataFrame | None) -> None:
    """Drop tables that `written` made and nothing reads any more; other frames are left alone."""
    for df in tables:
        found = _TABLES.pop(id(df), None)
        if found:
            _drop(df.sparkSession, found[1])


@atexit.register
def _release_all() -> None:
    released(*[df for df, _ in _TABLES.values()])


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of one key are dealt to this many groups where the other side is too large to be sent to all tasks.
SPREAD = 16


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, most: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has a key once at most. A key may hold any share of rows: keyed goes to all tasks while it has at most `most` rows, else to SPREAD groups of each key."""
    if keyed.count() <= most:
        return rows.join(F.broadcast(keyed), key, how)
    salt = fresh(rows, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int"))
    return dealt.join(keyed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), [key, salt], how).drop(salt)


#: Links up to this many (16 bytes each) are joined to components in one task; more are contracted over the cluster first.
SMALL = 250_000


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches over links a, b).

    Each round every root takes the least root next to any node of its tree, and labels jump until they
    are roots; roots that are not the least of what they see leave, so the links that cross trees die out.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        x, y = label[x], label[y]
        cross = x != y
        x, y = x[cross], y[cross]
    return nodes, nodes[label]


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = [*batches]
    if found:
        links = pd.concat(found)
        node, component = _least_reached(links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64))
        yield pd.DataFrame({"node": node, "component": component})


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); nodes without links are not listed.

    While there are more than `small` links, each node hooks to the least of its neighbours. Since the least
    neighbour of v's least neighbour is v or less, the only loops are two nodes that chose each other; the
    smaller one is the root. So each tree has two nodes or more, contraction to roots at least halves the
    nodes that still have links, and after log2 of their number of rounds none is left, whatever the order of
    ids. Pointers are halved until all are roots, which takes the logarithm of a tree's height. The rest is
    joined in one task. Rounds are cut by written tables. Nulls are no nodes; loops and repeats do no harm.
    """
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct())
    labels = None
    while (left := edges.count()) > small:
        # Rounds over few links are not dealt out finer than their rows deserve.
        parts = max(16, left // 250_000)
        hooks = written(edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).coalesce(parts))
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        tree = written(hooks.join(above, "up").select("node", F.when((F.col("next") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"), F.lit(True).alias("moved")).coalesce(parts))
        released(hooks)
        while True:
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = written(tree.drop("moved").join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")).coalesce(parts))
            released(tree)
            tree = jumped
            if jumped.where("moved").isEmpty():
                break
        a, b = (tree.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")) for end in "ab")
        crossing = edges.join(a, "a").join(b, "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        before, edges = edges, written(crossing.distinct().coalesce(parts))
        if labels is None:
            labels = tree.drop("moved")
        else:
            earlier, labels = labels, _followed(labels, tree)
            released(earlier, tree)
        released(before)
    last = written(edges.coalesce(1).mapInPandas(_in_one_task, "node long, component long"))
    released(edges)
    if labels is None:
        return last
    labels = _followed(labels, last.select("node", F.col("component").alias("up")))
    least = labels.groupBy("up").agg(F.min("node").alias("component"))
    return written(labels.join(least, "up").select("node", "component"))


def _followed(labels: DataFrame, tree: DataFrame) -> DataFrame:
    """labels (node, up) where what each goes up to has gone up in tree; roots without links stay."""
    to = tree.select(F.col("node").alias("up"), F.col("up").alias("to"))
    return written(labels.join(to, "up", "left").select("node", F.coalesce("to", "up").alias("up")))
