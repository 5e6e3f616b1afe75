"""Exact top-k search by inner product, with a pivot table that rules candidates out.

Vectors become integers, floor(scale * x). With the largest squared norm M of the table, x gets one more
component sqrt(M - |x|^2) and a query gets 0 there; then |q - x|^2 = |q|^2 + M - 2 q.x, and the largest inner
products are the smallest distances, so the triangle inequality holds for them. Distances of every vector to
PIVOTS pivots are computed once; max over pivots of |d(q, p) - d(x, p)| bounds d(q, x) from below, and so q.x
from above. Candidates of a block are evaluated in order of that bound until it falls below the k-th score
known; the first such score comes from a pilot set, so most blocks start with a useful one.

Candidates are grouped by nearest pivot, cut into blocks, and blocks are dealt to shards; every block of
queries goes to every shard. Each pair of blocks is one row, and gives at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, K, EVERY = 256, 5, 50
#: Bounds of what goes to every task: pivots, and the pilot set that gives first k-th scores.
PIVOTS, PILOT = 24, 512
#: Rows of a block of candidates and of queries; blocks of candidates in a shard.
BLOCK, QUERY_BLOCK, SHARD = 2048, 256, 8
#: Candidates evaluated before the bound is looked at again.
STEP = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>): whole numbers floor(scale * x). Vectors that are null, empty, or hold a null or non-finite component are left out, and rows without an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & F.coalesce(~bad, F.lit(False)) & (F.size(vector_col) > 0)
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are padded with zeros, which add nothing to an inner product."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows; in floating point where all sums stay below 2^53, else as Python integers."""
    if exact:
        return a @ b.T
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T


class Space:
    """What all tasks share: pivots, the pilot set, the largest squared norm. Its size does not depend on the table."""

    def __init__(self, width: int, norm: float, largest: float, pivots: list, pilot_ids: list, pilot: list):
        self.width, self.norm = width, norm
        self.exact = width * largest * largest < 2**52
        self.pivots, self.pilot = _matrix(pivots, width), _matrix(pilot, width)
        self.pilot_ids = np.array(pilot_ids, np.int64)
        self.pivot_lift = self._lift(self.pivots)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.norm - (x * x).sum(1)))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To each pivot, with the added component."""
        lift = np.zeros(len(x)) if query else self._lift(x)
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, square + (lift[:, None] - self.pivot_lift) ** 2))

    def upper(self, q: np.ndarray, dq: np.ndarray, dx: np.ndarray) -> np.ndarray:
        """For each candidate a score that its product with q cannot exceed.

        While all sums of products are whole numbers that doubles hold, only the added component is rounded, so a
        squared distance is wrong by `off` at most, a distance by 2 off / d or 2 sqrt(off), and the triangle
        inequality holds after these are taken off. Beyond that no distance is trusted and every pair is evaluated.
        """
        most = float(q @ q) + self.norm
        if not self.exact:
            return np.full(len(dx), np.inf)
        off = 64 * np.finfo(np.float64).eps * (most + self.norm)
        least = np.sqrt(off) + np.finfo(np.float64).tiny
        bound = np.maximum(0, np.abs(dx - dq) - 2 * off / np.maximum(dx, least) - 2 * off / np.maximum(dq, least)).max(axis=1)
        upper = (most - bound * bound) / 2
        return upper + 1e-6 * (1 + np.abs(upper)) + off

    def first_scores(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query within the pilot set, its own row left out: a lower bound of the final one."""
        if len(self.pilot_ids) <= k:
            return np.full(len(ids), -np.inf)
        s = _products(x, self.pilot, self.exact).astype(np.float64)
        s[ids[:, None] == self.pilot_ids] = -np.inf
        return np.sort(s, axis=1)[:, -k]


def best_of_block(space: Space, k: int, qid: int, q: np.ndarray, dq: np.ndarray, known: float, ids: np.ndarray, x: np.ndarray, dx: np.ndarray) -> list[tuple[int, int]]:
    """(vec_id, score) of at most k candidates of a block that can be among the k best of query q, given that k scores of `known` or more exist."""
    upper = space.upper(q, dq, dx)
    order = np.argsort(-upper, kind="stable")
    best: list[tuple[int, int]] = []
    for lo in range(0, len(order), STEP):
        at = order[lo : lo + STEP]
        if upper[at[0]] < known:
            break
        at = at[(upper[at] >= known) & (ids[at] != qid)]
        if not len(at):
            continue
        s = _products(q[None, :], x[at], space.exact)[0]
        near = np.flatnonzero(s.astype(np.float64) >= known)
        best += [(int(i), int(v)) for i, v in zip(ids[at[near]], s[near])]
        best = sorted(best, key=lambda b: (-b[1], b[0]))[:k]
        if len(best) == k:
            known = max(known, float(best[-1][1]))
    return best


def _blocks(space: Space, rows: int, query: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def block() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            x = _matrix(pdf["v"].tolist(), space.width)
            return pd.DataFrame({"ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "d": [space.distances(x, query).tobytes()]})

        for pdf in batches:
            while len(pdf):
                held.append(pdf[: rows - n])
                n += len(held[-1])
                pdf = pdf[len(held[-1]) :]
                if n == rows:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query.

    Queries are the rows whose id is divisible by `every`; candidates all rows of other ids. Ties go to the
    smaller vec_id; a query has fewer rows where there are fewer candidates. Rows that repeat an id with one
    vector count once. Vectors that are null or hold a null or non-finite component, and rows without an id, take no
    part; shorter vectors count as padded with zeros. An empty table gives an empty result.
    """
    table = written(quantised(vectors, id_col, vector_col, scale).distinct())
    size = table.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest")).first()
    some = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT).collect()  # PILOT vectors at most
    space = Space(size["width"] or 1, size["norm"] or 0.0, size["largest"] or 0.0, [r["v"] for r in some[:PIVOTS]], [r["vec_id"] for r in some], [r["v"] for r in some])
    shared = table.sparkSession.sparkContext.broadcast(space)
    block = "ids binary, x binary, d binary"

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = shared.value.distances(_matrix(pdf["v"].tolist(), shared.value.width), False)
            yield pdf.assign(pivot=d.argmin(1).astype(np.int32) if d.shape[1] else np.int32(0))

    grouped = table.mapInPandas(nearest, "vec_id long, v array<double>, pivot int").repartitionByRange("pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    candidates = written(grouped.select("vec_id", "v").mapInPandas(lambda b: _blocks(shared.value, BLOCK, False)(b), block))
    queries = table.where(F.col("vec_id") % every == 0).repartition(F.floor(F.col("vec_id") / (every * QUERY_BLOCK)))
    queries = written(queries.mapInPandas(lambda b: _blocks(shared.value, QUERY_BLOCK, True)(b), block))
    shards = max(1, -(-candidates.count() // SHARD))
    dealt = candidates.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("ids").alias("qids"), F.col("x").alias("qx"), F.col("d").alias("qd"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
                x, qx = (np.frombuffer(b, np.float64).reshape(-1, space.width) for b in (row.x, row.qx))
                dx, dq = (np.frombuffer(b, np.float64).reshape(-1, len(space.pivots)) for b in (row.d, row.qd))
                known = space.first_scores(qids, qx, k)
                found = [(q, *b) for j, q in enumerate(qids.tolist()) for b in best_of_block(space, k, q, qx[j], dq[j], known[j], ids, x, dx)]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = dealt.hint("shuffle_hash").join(asked, "shard").select("ids", "x", "d", "qids", "qx", "qd")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
