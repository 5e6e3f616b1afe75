"""Exact n-gram Jaccard self-join over prefix trees, and the components of its links.

A document's set is its distinct five-word shingles. The global order of shingles is (class, hash), where the
class grows with the number of sets that hold the shingle, counted over the whole table. Two sets with Jaccard
similarity of at least t share one of the first n - ceil(t n) + 1 shingles of both, in whatever global order.

1. One pass over the texts gives each document's set size and set fingerprint. Equal sets are one node.
2. A second pass ships (shingle, set) in packed blocks, one for each range of hashes. The task of a range counts
   the sets of each shingle and lets go of what one set alone has: it is in no overlap and stands first in the
   order. A shingle that a block of documents has often goes to ranges of its own, so no range is hot.
3. What is left meets again by set. A set with fewer than ceil(t n) shared shingles has its whole prefix among
   the others and is similar to nothing; such sets go. From here on a set is its size and its shared shingles.
4. Sets are grouped by shingles of their prefixes (least of a hash, so similar sets choose alike). Each group, cut
   into blocks, is one trie: sets travel once for a block, not once for a pair, and large groups of near copies
   become one component in a number of walks in proportion to their size.
5. What is still in different components and shares a shingle of both prefixes is compared pair by pair under
   the bounds of size and position; pairs inside a component can change no component. The smaller of two similar sets has
   a shared shingle among its first n - least overlap + 1, so keys without such a row make no pair. A key with
   many rows is cut into blocks of similar size, and each pair of blocks is a task's work of its own that ends in
   links, not in pairs.
6. Comparison walks a trie of ordered sets (sorted sequences with common-prefix lengths) with one set, reuses the
   overlap of shared paths, and leaves a subtree when what remains cannot reach the overlap needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, components, distinct, fresh, released, shingle_hashes, spread_join, written

#: Shingles packed at once by a task; shingles of a range of hashes, about.
PACK, RANGE = 1 << 20, 1 << 20
#: Sets of one packed block that must share a shingle for it to be dealt to LOADS ranges of its own.
LOAD, LOADS = 64, 64
#: Class of such shingles; others have 4 log2(sets), below it.
TOP = 255
#: Candidates of one anchor in one trie, about.
TRIE_SIZE = 256
#: Groups that a set is compared in before pairs are made; sets of such a group in one block.
ROUNDS, GROUP = 2, 512
#: Rows of a key above which it is cut into blocks; documents and shingles of a block, about.
CROWD, BLOCK, BLOCK_KEYS = 256, 1024, 1 << 20
#: Document ids are sent to all tasks up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 1_000_000
#: The same for fingerprints and components (24 bytes each).
BROADCAST_SETS = 250_000
_CLASS_SHIFT = np.uint64(56)


def _cut(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction of integers, so that ties at the threshold are exact."""
    num = round(similarity * 1000)
    if not 0 < num <= 1000:
        raise ValueError("similarity must be above 0 and at most 1")
    return num, 1000


def prefix_length(n: int, similarity: float) -> int:
    num, den = _cut(similarity)
    return n - -(-num * n // den) + 1


def least_overlap(a: int, b: int, similarity: float) -> int:
    """Smallest shared count o with o / (a + b - o) >= similarity."""
    num, den = _cut(similarity)
    return -(-num * (a + b) // (num + den))


def ordered_keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as integers that sort in the global order: class, then 56 bits of the hash. classes has one entry for each shingle."""
    return distinct((classes.astype(np.uint64) << _CLASS_SHIFT) | (hashes >> np.uint64(8)))


def trie_overlaps(anchor: np.ndarray, members: list[np.ndarray], similarity: float) -> list[int]:
    """Indexes of members whose similarity to anchor reaches the threshold.

    members form a trie: their sequences are walked in sorted order, so those under one node follow
    each other. cum holds the overlap at each depth of the current path as far as it was computed;
    the next sequence takes over the part it shares. A path is left as soon as its overlap plus what
    remains of the shorter side misses the overlap needed, and its subtree starts from that depth.
    """
    order = sorted(range(len(members)), key=lambda i: _bytes(members[i]))
    needs = [least_overlap(len(anchor), len(members[i]), similarity) for i in order]
    return [order[i] for i in _walked(anchor, [members[i] for i in order], needs)]


def _bytes(keys: np.ndarray) -> bytes:
    """Bytes that sort as the keys do."""
    return keys.astype(">u8").tobytes()


def _walked(anchor: np.ndarray, members: list[np.ndarray], needs: list[int], steps: list[int] | None = None) -> list[int]:
    """Places of members, given in sorted order, that share at least as many keys with anchor as each needs. The keys compared are added to steps."""
    found: list[int] = []
    path, cum = np.empty(0, np.uint64), np.zeros(1, np.int64)
    for i, (seq, need) in enumerate(zip(members, needs)):
        n, na = len(seq), len(anchor)
        shared = min(len(seq), len(cum) - 1)
        differ = np.flatnonzero(path[:shared] != seq[:shared])
        depth = int(differ[0]) if len(differ) else shared
        path, cum = seq, cum[: depth + 1]
        if min(n, na) < need:
            continue
        parts, have = [cum], int(cum[-1])
        while True:
            passed = int(np.searchsorted(anchor, seq[depth - 1], side="right")) if depth else 0
            if have + min(n - depth, na - passed) < need or depth == n:
                break
            step = seq[depth : depth + 128]
            at = np.minimum(np.searchsorted(anchor, step), na - 1)
            parts.append(have + np.cumsum(anchor[at] == step))
            have, depth = int(parts[-1][-1]), depth + len(step)
            if steps is not None:
                steps.append(len(step))
        cum = np.concatenate(parts)
        if depth == n and have >= need:
            found.append(i)
    return found


_PROFILE = "doc_id long, n int, fingerprint binary, alone long"


def _profile(k: int):
    """Of each row its set's size and fingerprint, and an id below zero that the set goes by where its row's id has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
            sets = [shingle_hashes(t, k) for t in batch.column("text").to_pylist()]
            prints = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            columns = [batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int32()), pa.array(prints, pa.binary()), pa.array(map(_alone, prints), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "fingerprint", "alone"])

    return run


def _alone(fingerprint: bytes) -> int:
    return -1 - (int.from_bytes(fingerprint[:8], "little") >> 2)


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lower bytes of integers, all first bytes first: what neighbours have in common is easily compressed."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


_PACKED = "range long, hashes binary, refs binary"
#: Stands for a set in the range of a shingle that was dealt elsewhere.
_MARK = np.uint64(1 << 63)


def _packed(k: int, ranges: int):
    """Blocks of (hash, ref) in order of hash, one for each range of hashes; frequent shingles go to ranges below zero, with a mark in their own range."""
    bits = np.uint64(56 - (ranges - 1).bit_length())

    def blocks(sets: list[np.ndarray], refs: list[int], number: int) -> pa.RecordBatch:
        h = np.concatenate(sets) >> np.uint64(8)
        ref = np.repeat(np.array(refs, np.int64).view(np.uint64), [len(s) for s in sets])
        order = np.argsort(h, kind="stable")
        h, ref = h[order], ref[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(start, len(h)))
        loaded = np.repeat(count >= LOAD, count)
        rows: list[tuple[int, bytes, bytes]] = []
        if loaded.any():
            hot = start[count >= LOAD]
            rows.append((-1 - number % LOADS, _planes(h[loaded], 7), _planes(ref[loaded], 8)))
            h, ref = np.concatenate([h[~loaded], h[hot]]), np.concatenate([ref[~loaded], np.full(len(hot), _MARK)])
            order = np.argsort(h, kind="stable")
            h, ref = h[order], ref[order]
        at = (h >> bits).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            rows.append((int(at[lo]), _planes(h[lo:hi], 7), _planes(ref[lo:hi], 8)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["range", "hashes", "refs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[tuple[bytes, int]] = set()
        sets, refs, held, number = [], [], 0, TaskContext.get().partitionId()
        for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
            for doc, several, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "several", "text"))):
                h = shingle_hashes(text, k)
                if not len(h):
                    continue
                own = xxhash.xxh3_128_digest(h.tobytes())
                ref = _alone(own) if several else doc
                if (own, ref) in seen:
                    continue
                seen.add((own, ref))
                sets.append(h)
                refs.append(ref)
                held += len(h)
                if held >= PACK:
                    yield blocks(sets, refs, number)
                    sets, refs, held, number = [], [], 0, number + 1
                    seen.clear()
        if sets:
            yield blocks(sets, refs, number)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, key) of shingles that more than one set has. Rows come in order of range; one range is held at a time."""

    def keys(at: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        h, ref = (np.concatenate([_from_planes(x[i], size) for x in held]) for i, size in ((0, 7), (1, 8)))
        if at < 0:
            kind = np.full(len(h), TOP)
        else:
            order = np.argsort(h, kind="stable")  # runs in order are merged
            h, ref = h[order], ref[order]
            like = h[1:] == h[:-1]
            more = np.append(like, False) | np.append(False, like)
            h, ref = h[more], ref[more]
            order = np.lexsort((ref, h))
            h, ref = h[order], ref[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (ref[1:] != ref[:-1])
            h, ref = h[new], ref[new]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(h)))
            marked = np.add.reduceat(ref == _MARK, start) > 0 if len(h) else np.zeros(0, bool)
            kind = np.repeat(np.where(marked, TOP, np.minimum(TOP - 1, 4 * np.log2(np.maximum(count, 1)))).astype(np.int64), count)
            keep = (np.repeat(count, count) > 1) & (ref != _MARK)
            h, ref, kind = h[keep], ref[keep], kind[keep]
        key = (kind.astype(np.uint64) << _CLASS_SHIFT) | h
        return pa.RecordBatch.from_arrays([pa.array(ref.view(np.int64)), pa.array(key.view(np.int64))], ["ref", "key"])

    at, held = None, []
    for batch in batches:
        for r, h, ref in zip(*(batch.column(c).to_pylist() for c in ("range", "hashes", "refs"))):
            if held and (r != at or r < 0):
                yield keys(at, held)
                held = []
            at = r
            held.append((h, ref))
    if held:
        yield keys(at, held)


_SETS = "doc long, n int, keys binary"


def _gathered(similarity: float):
    """Sets with as many shared shingles as any partner asks for; keys are in the global order."""
    num, den = _cut(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, keys in zip(batch.column("ref").to_pylist(), batch.column("n").to_pylist(), batch.column("keys")):
                own = distinct(keys.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                if len(own) * den >= num * n:
                    out.append((doc, n, own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc", "n", "keys"])

    return run


_TOKEN = "token long, doc long, n int, rank int, last long"


def _prefixes(similarity: float):
    """The shared shingles of each set's prefix. Those of one set alone stand first and are left out, so rank starts after them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
            n = pdf["n"].to_numpy(np.int64)
            alone = n - np.array([len(x) for x in keys], np.int64)
            keys = [x[: max(0, prefix_length(int(m), similarity) - int(a))] for x, m, a in zip(keys, n, alone)]
            sizes = np.array([len(x) for x in keys], np.int64)
            if not sizes.sum():
                continue
            last = np.array([x[-1] if len(x) else 0 for x in keys], np.uint64).view(np.int64)
            rank = np.concatenate([a + np.arange(s) for a, s in zip(alone, sizes)])
            yield pd.DataFrame({"token": np.concatenate(keys).view(np.int64), "doc": np.repeat(pdf["doc"].to_numpy(np.int64), sizes), "n": np.repeat(n, sizes).astype(np.int32), "rank": rank.astype(np.int32), "last": np.repeat(last, sizes)})

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of token: keeps those whose token another row has.

    A group may span batches; the last row of a batch waits for the next one, so memory is one batch.
    """
    tail: pd.DataFrame | None = None
    before: int | None = None  # token of the last row that went through
    for pdf in chain(batches, [None]):
        if pdf is not None and not len(pdf):
            continue
        rows = pdf if tail is None else tail if pdf is None else pd.concat([tail, pdf], ignore_index=True)
        if rows is None:
            return
        token = rows["token"].to_numpy()
        like = token[1:] == token[:-1]
        keep = np.append(before == token[0], like) | np.append(like, False)
        end = len(rows) if pdf is None else len(rows) - 1
        tail = rows[end:]
        if end:
            before = token[end - 1]
        if keep[:end].any():
            yield rows[:end][keep[:end]]


def _group_links(similarity: float):
    """Links that connect the similar sets of one block: each set walks the trie of those that are not yet in its component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = sorted(((_bytes(np.frombuffer(x, np.uint64)), doc, n, np.frombuffer(x, np.uint64)) for doc, n, x in zip(pdf["doc"], pdf["n"], pdf["keys"])), key=lambda x: x[0])
        doc, n = (np.array([x[i] for x in items], np.int64) for i in (1, 2))
        num, den = _cut(similarity)
        comp, a, b = np.arange(len(items)), [], []
        for x in range(len(items) - 1):
            y = x + 1 + np.flatnonzero(comp[x + 1 :] != comp[x])
            y = y[np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num]
            for i in _walked(items[x][3], [items[i][3] for i in y], [least_overlap(int(n[x]), int(n[i]), similarity) for i in y]):
                if comp[y[i]] != comp[x]:
                    a.append(doc[x])
                    b.append(doc[y[i]])
                    comp[comp == comp[y[i]]] = comp[x]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def group_links(sets: DataFrame, tokens: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """Links (a, b) within groups of sets that choose the same shingle of tokens (token, doc): in each round the one with the least hash."""
    chosen = tokens.groupBy("doc").agg(F.array_distinct(F.array(*(F.min_by("token", F.xxhash64("token", F.lit(i))) for i in range(rounds)))).alias("tokens")).select("doc", F.explode("tokens").alias("token"))
    sizes = tokens.groupBy("token").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))  # those who choose are among those who have
    dealt = chosen.join(sizes, "token").select("token", F.expr("pmod(xxhash64(doc, token), blocks)").alias("block"), "doc")
    alone = dealt.groupBy("token", "block").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    dealt = dealt.join(alone, ["token", "block"])
    return dealt.join(sets, "doc").groupBy("token", "block").applyInPandas(_group_links(similarity), "a long, b long")


_PAIR = "anchor long, doc long, na int, n int, ra int, rank int, la long, last long, apart int"


def _cross_pairs(similarity: float):
    """Pairs of one token's sets from different components whose sizes can match. Rows come in order of token; memory is one group, which must be small."""
    num, den = _cut(similarity)

    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        c = {name: pdf[name].to_numpy(np.int64) for name in ("token", "doc", "n", "rank", "last", "comp", "apart")}
        i, step = np.arange(len(pdf) - 1), 1
        while len(i := i[i + step < len(pdf)]) and len(i := i[c["token"][i] == c["token"][i + step]]):
            j = i + step
            small, large = np.minimum(c["n"][i], c["n"][j]), np.maximum(c["n"][i], c["n"][j])
            ok = (c["comp"][i] != c["comp"][j]) & (small * den >= large * num)
            x, y = i[ok], j[ok]
            if len(x):
                low = c["doc"][x] < c["doc"][y]
                x, y = np.where(low, x, y), np.where(low, y, x)
                yield pd.DataFrame({"anchor": c["doc"][x], "doc": c["doc"][y], "na": c["n"][x], "n": c["n"][y], "ra": c["rank"][x], "rank": c["rank"][y], "la": c["last"][x], "last": c["last"][y], "apart": np.minimum(c["apart"][x], c["apart"][y])})
            step += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["token"].iloc[-1]
            held.append(pdf)
            if held[0]["token"].iloc[0] == last:  # one group so far
                continue
            pdf = pd.concat(held, ignore_index=True)
            held = [pdf[pdf["token"] == last]]
            yield from pairs(pdf[pdf["token"] != last])
        if held:
            yield from pairs(pd.concat(held, ignore_index=True))

    return run


def _verified(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
        own = pdf["doc"].to_numpy() == pdf["anchor"].to_numpy()
        if not own.any():
            return pd.DataFrame({"a": [], "b": []})
        n, at = pdf["n"].to_numpy(np.int64), int(np.flatnonzero(own)[0])
        rest = sorted(np.flatnonzero(~own), key=lambda i: _bytes(sets[i]))
        hits = _walked(sets[at], [sets[i] for i in rest], [least_overlap(int(n[at]), int(n[i]), similarity) for i in rest])
        found = [rest[i] for i in hits]
        return pd.DataFrame({"a": pdf["anchor"].to_numpy()[found], "b": pdf["doc"].to_numpy()[found]}) if found else pd.DataFrame({"a": [], "b": []})

    return run


def verified_links(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among candidate pairs (anchor, doc). An anchor's candidates are dealt to tries of about TRIE_SIZE, each with the anchor's set."""
    pairs = written(pairs.select("anchor", "doc").distinct())
    many = pairs.groupBy("anchor").agg(F.ceil(F.count("*") / TRIE_SIZE).cast("int").alias("parts"))
    dealt = pairs.join(many, "anchor").select("anchor", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), "doc")
    members = dealt.union(many.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("anchor").alias("doc")))
    return members.join(sets, "doc").groupBy("anchor", "part").applyInPandas(_verified(similarity), "a long, b long")


def _block_links(similarity: float):
    """Links among the sets of one token in a pair of blocks, no more than connect their components.

    Sets are cut before the token. A pair whose first common key it is loses nothing; any other pair is
    compared under its own first common key, and is left out here where the keys before the token are equal.
    """
    num, den = _cut(similarity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token = np.array([pdf["token"].iloc[0]], np.int64).view(np.uint64)[0]
        items = []
        for doc, comp, right, size, data in zip(pdf["doc"], pdf["comp"], pdf["right"], pdf["n"], pdf["keys"]):
            keys = np.frombuffer(data, np.uint64)
            at = int(np.searchsorted(keys, token))
            if at < len(keys) and keys[at] == token:
                items.append((_bytes(keys[at:]), doc, comp, right, size, keys[at:], keys[at - 1] if at else token))
        items.sort(key=lambda x: x[0])
        doc, comp, n, rest = (np.array([x[i] for x in items], np.int64) for i in (1, 2, 4, 4))
        rest[:] = [len(x[5]) for x in items]
        before, right = np.array([x[6] for x in items], np.uint64), np.array([x[3] for x in items], bool)
        within, a, b = not right.any() and bool(pdf["within"].iloc[0]), [], []
        for x in range(len(items)) if within else np.flatnonzero(~right):
            y = np.arange(x + 1, len(items)) if within else np.flatnonzero(right)
            y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num)]
            y = y[np.minimum(rest[y], rest[x]) * (num + den) >= num * (n[y] + n[x])]
            y = y[(before[y] != before[x]) | (before[y] == token)]
            for i in _walked(items[x][5], [items[i][5] for i in y], [least_overlap(int(n[x]), int(n[i]), similarity) for i in y]):
                if comp[y[i]] != comp[x]:
                    a.append(doc[x])
                    b.append(doc[y[i]])
                    comp[comp == comp[y[i]]] = comp[x]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def crowded_links(sets: DataFrame, rows: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of similar sets from different components among rows (token, doc, n, comp).

    Sizes fall into classes such that similar sets are in one or in neighbours. A token's sets of a class
    are dealt to blocks, and every two blocks that can match are one group, whatever token they are of.
    """
    num, den = _cut(similarity)
    step = max(math.log(den / num) * 1.0001, 0.001)  # wider than the ratio of sizes, so rounding loses no neighbour
    sized = rows.select("token", "doc", "comp", F.floor(F.log("n") / step).cast("int").alias("size")).distinct()
    most = F.greatest(F.lit(16), F.least(F.lit(block), F.floor(BLOCK_KEYS / F.exp((F.col("size") + 1) * step))))
    grid = written(sized.groupBy("token", "size").agg(F.count("*").alias("c")).select("token", "size", F.ceil(F.col("c") / most).cast("int").alias("own")))
    up, down = (grid.select("token", (F.col("size") + d).alias("size"), F.col("own").alias(name)) for d, name in ((-1, "up"), (1, "down")))
    full = grid.join(up, ["token", "size"], "left").join(down, ["token", "size"], "left").fillna(0)
    if grid.count() <= BROADCAST_IDS:
        full = F.broadcast(full)
    dealt = sized.join(full, ["token", "size"]).withColumn("h", F.expr("cast(pmod(xxhash64(doc), own) as int)"))
    places = F.expr("""concat(
        transform(sequence(0, own - 1), x -> named_struct('lo', size, 'hi', size, 'i', least(h, x), 'j', greatest(h, x), 'right', x < h)),
        transform(slice(sequence(0, up), 1, up), x -> named_struct('lo', size, 'hi', size + 1, 'i', h, 'j', x, 'right', false)),
        transform(slice(sequence(0, down), 1, down), x -> named_struct('lo', size - 1, 'hi', size, 'i', x, 'j', h, 'right', true)))""")
    placed = dealt.select("token", "doc", "comp", F.explode(places).alias("at")).select("token", "doc", "comp", "at.*")
    placed = placed.withColumn("within", F.expr("lo = hi and i = j"))
    return placed.join(sets, "doc").groupBy("token", "lo", "hi", "i", "j").applyInPandas(_block_links(similarity), "a long, b long")


def _possible(num: int, den: int):
    """The overlap needed can still be met from the first shared shingle on."""
    return F.least(F.col("na") - F.col("ra"), F.col("n") - F.col("rank")) * (num + den) >= num * (F.col("na") + F.col("n"))


def remaining_links(sets: DataFrame, tokens: DataFrame, near: DataFrame | None, similarity: float) -> DataFrame | None:
    """Links (a, b) of similar sets from different components of near (node, component) among tokens (token, doc, n, rank, last)."""
    num, den = _cut(similarity)
    labelled = tokens.withColumn("comp", F.col("doc"))
    if near:
        labelled = written(tokens.join(near, tokens.doc == near.node, "left").select(*tokens.columns, F.coalesce("component", "doc").alias("comp")))
    # Whether a row's set can be the smaller one of a similar pair with this first shared shingle.
    first = (F.col("n") - F.col("rank")) * (num + den) >= 2 * num * F.col("n")
    mixed = labelled.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max(first).alias("first")).groupBy("token").agg(F.sum("c").alias("rows"), F.count("*").alias("comps"), F.max("first").alias("first"))
    mixed = written(mixed.where("comps > 1"))
    if mixed.where("first").isEmpty():
        return None
    kind = F.when(~F.col("first"), "none").when(F.col("rows") > CROWD, "blocks").otherwise("pairs")
    rest = written(labelled.join(mixed.select("token", kind.alias("kind")), "token"))
    blocks = crowded_links(sets, rest.where("kind = 'blocks'"), similarity)
    # Shingles that a set may share outside the keys that make pairs.
    apart = rest.where("kind <> 'pairs'").groupBy("doc").agg(F.count("*").cast("int").alias("apart"))
    rest = rest.where("kind = 'pairs'").join(apart, "doc", "left").fillna(0, ["apart"])
    pairs = rest.repartition("token").sortWithinPartitions("token").mapInPandas(_cross_pairs(similarity), _PAIR)
    pairs = pairs.groupBy("anchor", "doc", "na", "n", "la", "last").agg(F.min("ra").alias("ra"), F.min("rank").alias("rank"), F.count("*").alias("common"), F.max("apart").alias("apart"))
    # What both prefixes share, and what may follow the prefix that ends first.
    after = F.when(F.col("la") < F.col("last"), F.col("na")).when(F.col("la") > F.col("last"), F.col("n")).otherwise(F.least("na", "n"))
    pairs = pairs.where(_possible(num, den)).where((F.col("common") + F.col("apart") + F.ceil(after * num / den) - 1) * (num + den) >= num * (F.col("na") + F.col("n")))
    return verified_links(sets, pairs, similarity).union(blocks)


def _joined(near: DataFrame, links: DataFrame) -> DataFrame:
    """near (node, component) after more links: only the components that they connect are worked on."""

    def least(of: DataFrame, end: str) -> DataFrame:
        return of.join(near, of[end] == near.node, "left").withColumn(end, F.coalesce("component", end)).drop("node", "component")

    moved = components(least(least(links, "a"), "b"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = moved.join(near, "node", "left_anti")
    return written(near.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(new))


def shared_sets(docs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc, n, keys) of the sets that can be similar to another one: keys are their shared shingles in the global order.

    docs: doc_id, text, several. nodes (fingerprint, ref, n, copies): one row for each distinct set; a set is known by its ref.
    """
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(4 * partitions - 1, letters // (6 * RANGE)).bit_length()
    packed = docs.mapInArrow(_packed(k, ranges), _PACKED).repartition("range").sortWithinPartitions("range")
    shared = packed.mapInArrow(_shared, "ref long, key long").groupBy("ref").agg(F.collect_list("key").alias("keys"))
    kept = shared.join(nodes.select("ref", "n"), "ref")
    return written(kept.where(F.size("keys") * _cut(similarity)[1] >= F.col("n") * _cut(similarity)[0]).select("ref", "n", "keys").mapInArrow(_gathered(similarity), _SETS))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null text and text without words: empty set, linked with nothing. Rows with a null id keep a null
    component and take no part. Rows that repeat an id are one node with several texts: what any of them
    links with, the id links with. Other columns are not read. An empty table gives an empty result.
    Shingles are told apart by 64 bits of a hash (56 in overlaps), sets by 128.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(docs.mapInArrow(_profile(k), _PROFILE))
    full = rows.where("n > 0 and doc_id is not null")
    # Ids with several sets; such a set goes by an id of its own, unless a row with one set has it too.
    several = written(full.groupBy("doc_id").agg(F.min("fingerprint").alias("x"), F.max("fingerprint").alias("y")).where("x <> y").select("doc_id"))
    torn = several.count()
    marked = full.withColumn("several", F.lit(False))
    if torn:
        marked = full.join(several.withColumn("several", F.lit(True)), "doc_id", "left").fillna(False, ["several"])
    own = F.when(~F.col("several"), F.col("doc_id"))
    nodes = marked.groupBy("fingerprint").agg(F.coalesce(F.min(own), F.min("alone")).alias("ref"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"))
    nodes = written(nodes)

    docs = docs.where("doc_id is not null")
    if torn:
        named = several.withColumn("several", F.lit(True))
        docs = docs.join(F.broadcast(named) if torn <= BROADCAST_IDS else named, "doc_id", "left").fillna(False, ["several"])
    else:
        docs = docs.withColumn("several", F.lit(False))
    # A set goes under its ref alone: by leaving its other rows out here if they are few, else by nodes having no such ref.
    copies = spread_join(marked.where("not several").select("fingerprint", "doc_id"), nodes.where("copies > 1").select("fingerprint", "ref"), "fingerprint", BROADCAST_SETS)
    copies = written(copies.where("ref <> doc_id").select("doc_id"))
    single = docs
    if copies.count() <= BROADCAST_IDS:
        single = docs.join(F.broadcast(copies.distinct()), "doc_id", "left_anti")
    sets = shared_sets(single.select("doc_id", "several", "text"), nodes, k, similarity)
    tokens = sets.mapInPandas(_prefixes(similarity), _TOKEN).repartition("token").sortWithinPartitions("token").mapInPandas(_met, _TOKEN)
    tokens = written(tokens)

    near = None
    if ROUNDS:
        near = components(group_links(sets, tokens, similarity, ROUNDS))
    more = remaining_links(sets, tokens, near, similarity)
    if more is not None:
        more = written(more)
        near = _joined(near, more) if near else components(more)
    released(tokens, sets)

    # Components of sets: the least id of all rows of all their sets.
    linked = nodes.select("fingerprint", "ref", "copies", "least").withColumn("component", F.col("least"))
    if near:
        grouped = near.select(F.col("node").alias("ref"), F.col("component").alias("group")).join(nodes.select("ref", "least"), "ref")
        low = written(grouped.groupBy("group").agg(F.min("least").alias("component")))
        named = spread_join(grouped.select("ref", "group"), low, "group", BROADCAST_SETS).select("ref", F.col("component").alias("low"))
        linked = linked.join(named, "ref", "left").withColumn("component", F.coalesce("low", "least"))
    labelled = written(linked.where("copies > 1 or component <> ref").select("fingerprint", "component"))
    out = spread_join(rows, labelled, "fingerprint", BROADCAST_SETS, "left")
    out = out.withColumn("component", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")))
    if not torn:
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    # What the texts of one id are linked with is linked through it.
    out = written(out.withColumn("component", F.coalesce("component", "doc_id")))
    ties = components(out.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
    ties = ties.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return out.join(ties, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("whole", "component").alias("component_id"))


def without_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = 0.8) -> DataFrame:
    """Rows of documents, with all their columns, whose id is the least of its component. Rows without an id stay."""
    found = jaccard_components(documents, id_col, text_col, k, similarity)
    gone, own = fresh(documents, "gone"), F.col(id_col).cast("long")
    ids = written(found.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return documents.join(ids, own == F.col(gone), "left_anti")
