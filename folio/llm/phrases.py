"""Collocations by bitmaps of positions: a phrase grows by a shift, an AND and a count of bits.

Documents are dealt into shards as they are read. In a shard the words of one language stand at consecutive positions,
with one left free at each end of a piece, so nothing is adjacent across pieces. Each word has a bitmap of its positions,
of which only blocks of 16 with a bit in them are kept. The bitmap of a phrase holds where its last word stands: shifted
by one and ANDed with a word's bitmap it becomes that of the longer phrase, and its bits are the phrase's number.

Two walks are made. The first extends all words by one; the numbers of pairs are summed over shards under hashes of 40
bits, and shards are told which hashes reach the least number: no pair that does is lost, and a pair that does not is
found out when it is counted exactly. The second walk extends depth first, by frequent pairs only, up to the longest
phrases. What it finds is counted under its own text over all shards; shards hand their numbers on packed, by parts of
the phrases' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, ragged, written

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Words of a shard from which on it takes no further document, and bytes of a long text that are looked at at once.
SHARD, STRETCH = 1 << 21, 1 << 22
#: Positions of a block, blocks that are extended at once, and bits of a pair's hash.
BLOCK, CHUNK, BITS = 16, 1 << 17, 40
#: Hashes are summed in groups: PARTS of them, and one more for each GROUP words of the table.
PARTS, GROUP = 64, 1 << 22
#: The first ranks are taken from this many groups of each language before they are put in one order.
SALTS = 64
#: Pieces end at . , ; : ! ? and line ends; words are parted by spaces and tabs. "." is put for all ends of pieces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Another language of equal words gives other hashes.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Factors of the hashes of the words of a phrase, by place.
_ODDS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with b"." at each end of a piece, in lists of bounded size."""
    raw, at = raw.translate(_LETTERS), 0
    while at < len(raw):
        end = raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(b".", b" . ").split()
        at = end


class Bitmaps:
    """Blocks of the bitmaps of all words, in the order of words and blocks."""

    def __init__(self, word: np.ndarray, block: np.ndarray, mask: np.ndarray):
        self.word, self.block, self.mask = word, block, mask
        order = np.argsort(block, kind="stable")
        self.by_block, self.ends = order, np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 3))

    @staticmethod
    def of(at: np.ndarray) -> Bitmaps:
        """From the word at each position; -1 is none."""
        place = np.flatnonzero(at >= 0)
        word = at[place].astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        key = (word << 32) | (place // BLOCK)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        mask = np.bitwise_or.reduceat((1 << (place % BLOCK)).astype(np.uint16), starts) if len(key) else np.empty(0, np.uint16)
        return Bitmaps(word[starts].astype(np.int32), (place // BLOCK)[starts].astype(np.int32), mask)

    def counts(self, words: int) -> np.ndarray:
        return np.bincount(self.word, np.bitwise_count(self.mask), words).astype(np.int64)

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, block, mask) of what is not empty of each phrase's bitmap, shifted by one and ANDed with those of all words."""
        over = np.flatnonzero(mask >> (BLOCK - 1))
        inside = np.flatnonzero(mask << 1 & 0xFFFF)
        phrase = np.concatenate([phrase[inside], phrase[over]])
        shifted = np.concatenate([(mask[inside] << 1).astype(np.uint16), np.ones(len(over), np.uint16)])
        block = np.concatenate([block[inside], block[over] + 1])
        many = self.ends[block + 1] - self.ends[block]
        other = self.by_block[ragged(self.ends[block], many)]
        both = np.repeat(shifted, many) & self.mask[other]
        hit = np.flatnonzero(both)
        other = other[hit]
        return np.repeat(phrase, many)[hit], self.word[other], self.block[other], both[hit]

    def chunks(self) -> Iterator[slice]:
        """Ranges of blocks that end between words, of about CHUNK; a word with more stands alone."""
        ends = np.append(np.flatnonzero(self.word[1:] != self.word[:-1]) + 1, len(self.word)) if len(self.word) else []
        lo = last = 0
        for hi in [*ends]:
            if hi - lo > CHUNK and last > lo:
                yield slice(lo, last)
                lo = last
            last = hi
        if last > lo:
            yield slice(lo, last)


def grouped(phrase: np.ndarray, word: np.ndarray, mask: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase * words + word, each once; number of bits; for each block, the place of its key)."""
    keys, place = np.unique(phrase.astype(np.int64) * words + word, return_inverse=True)
    return keys, np.bincount(place, np.bitwise_count(mask), len(keys)).astype(np.int64), place


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _loose(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


_BASE = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("size", pa.binary()), ("block", pa.binary()), ("mask", pa.binary())])


class _Open:
    """Words of one language and shard."""

    def __init__(self):
        self.vocabulary, self.at = {b".": -1}, []

    def add(self, raw: bytes) -> int:
        n = 0
        for part in words_of(raw):
            for w in set(part).difference(self.vocabulary):
                self.vocabulary[w] = len(self.vocabulary) - 1
            self.at.append(np.fromiter(map(self.vocabulary.__getitem__, part), np.int32, len(part)))
            n += len(part)
        self.at.append(np.array([-1], np.int32))
        return n

    def row(self, shard: int, lang: str) -> dict:
        words = [w.decode("utf-8", "replace") for w in self.vocabulary][1:]
        maps = Bitmaps.of(np.concatenate(self.at))
        return {"shard": shard, "lang": lang, "words": words, "counts": maps.counts(len(words)), "size": _squeezed(np.bincount(maps.word, minlength=len(words)).astype(np.int32)), "block": _squeezed(_steps(maps.block)), "mask": _squeezed(maps.mask)}


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, held, total = TaskContext.get().partitionId() << 32, {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            if len(words.vocabulary) > 1:
                yield pa.RecordBatch.from_pylist([words.row(shard, lang)], _BASE)

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            total += held.setdefault(lang, _Open()).add(raw.as_py() or b"")
            if total >= SHARD:
                yield from out()
                shard, held, total = shard + 1, {}, 0
    yield from out()


def _bitmaps(batch: pa.RecordBatch, i: int) -> Bitmaps:
    size = _loose(batch.column("size")[i].as_py(), np.int32)
    block = np.cumsum(_loose(batch.column("block")[i].as_py(), np.int32), dtype=np.int32)
    return Bitmaps(np.repeat(np.arange(len(size), dtype=np.int32), size), block, _loose(batch.column("mask")[i].as_py(), np.uint16))


def _word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _pair_hashes(h: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(h[first] * _ODD[0] + h[second] * _ODD[1]) >> np.uint64(64 - BITS)


def _pairs(parts: int):
    """The first walk: for each part of the hashes (steps between them, numbers) of the pairs of a shard."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column("lang")[i].as_py(), batch.column("words")[i].values
                maps, h = _bitmaps(batch, i), _word_hashes(lang, words)
                hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for some in maps.chunks():
                    phrase, word, _, mask = maps.extended(maps.word[some], maps.block[some], maps.mask[some])
                    keys, bits, _ = grouped(phrase, word, mask, len(words))
                    hashes.append(_pair_hashes(h, keys // len(words), keys % len(words)))
                    counts.append(bits)
                hashes, place = np.unique(np.concatenate(hashes), return_inverse=True)
                counts = np.bincount(place, np.concatenate(counts), len(hashes)).astype(np.int64)
                cuts = np.searchsorted(hashes, (np.arange(parts + 1, dtype=object) * (1 << BITS) // parts).astype(np.uint64))
                rows = [{"part": p, "shard": batch.column("shard")[i].as_py(), "lang": lang, "hashes": _squeezed(_steps(hashes[a:b])), "counts": _squeezed(counts[a:b])} for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _frequent(least: int):
    """Which hashes of one part reach the least number over all shards, told to each shard that holds them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(_loose(x, np.uint64), dtype=np.uint64) for x in pdf["hashes"]]
        known, place = np.unique(np.concatenate(hashes), return_inverse=True)
        often = np.bincount(place, np.concatenate([_loose(x, np.int64) for x in pdf["counts"]]), len(known)) >= least
        told = [h[x] for h, x in zip(hashes, np.split(often[place], np.cumsum([len(h) for h in hashes])[:-1]))]
        out = pd.DataFrame({"shard": pdf["shard"], "lang": pdf["lang"], "pairs": [t.tobytes() for t in told]})
        return out[[len(t) > 0 for t in told]]

    return run


def _texts(words: pa.Array, parts: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(p)) for p in parts.T], " ")


def _deeper(maps: Bitmaps, parts: np.ndarray, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, pairs: np.ndarray, words: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of the phrases, numbers) of all extensions of phrases by frequent pairs, depth first."""
    phrase, word, block, mask = maps.extended(phrase, block, mask)
    wanted = parts[phrase, -1].astype(np.int64) * words + word
    hit = pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted
    phrase, word, block, mask = phrase[hit], word[hit], block[hit], mask[hit]
    if not len(phrase):
        return
    keys, bits, place = grouped(phrase, word, mask, words)
    longer = np.column_stack([parts[keys // words], (keys % words).astype(np.int32)])
    yield longer, bits
    if longer.shape[1] < longest:
        yield from _deeper(maps, longer, place, block, mask, pairs, words, longest)


def _phrases(longest: int, parts: int):
    """The second walk: phrases of two words and more, and their numbers in a shard, packed by parts of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column("lang")[i].as_py(), batch.column("words")[i].values
                maps, h, n = _bitmaps(batch, i), _word_hashes(lang, words), len(words)
                told = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column("pairs")[i].as_py()]))
                first, chunks = [], []
                for some in maps.chunks():
                    phrase, word, block, mask = maps.extended(maps.word[some], maps.block[some], maps.mask[some])
                    keys, bits, place = grouped(phrase, word, mask, n)
                    hashes = _pair_hashes(h, keys // n, keys % n)
                    often = told[np.minimum(np.searchsorted(told, hashes), len(told) - 1)] == hashes
                    hit = often[place]
                    first.append(keys[often])
                    chunks.append((keys[often], bits[often], (np.cumsum(often) - 1)[place[hit]], block[hit], mask[hit]))
                pairs = np.concatenate(first)
                counted = _Packed(batch.column("shard")[i].as_py(), lang, parts)
                for keys, bits, phrase, block, mask in chunks:
                    if not len(keys):
                        continue
                    pair = np.column_stack([keys // n, keys % n]).astype(np.int32)
                    for p, c in [(pair, bits), *(_deeper(maps, pair, phrase, block, mask, pairs, n, longest) if longest > 2 else ())]:
                        counted.add(_texts(words, p), c, h[p] @ _ODDS[: p.shape[1]])
                yield from counted.rows()

    return run


class _Packed:
    """Phrases of a shard and their numbers, as one row for each part of their hashes."""

    def __init__(self, shard: int, lang: str, parts: int):
        self.shard, self.lang, self.parts, self.held = shard, lang, parts, []

    def add(self, texts: pa.Array, counts: np.ndarray, hashes: np.ndarray) -> None:
        self.held.append((texts, counts, (mix(hashes) % np.uint64(self.parts)).astype(np.int32)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        texts, counts, part = pa.chunked_array([t for t, _, _ in self.held]).combine_chunks(), np.concatenate([c for _, c, _ in self.held]), np.concatenate([p for _, _, p in self.held])
        order = np.argsort(part, kind="stable")
        texts, counts, ends = texts.take(pa.array(order)), counts[order], np.searchsorted(part[order], np.arange(self.parts + 1))
        rows = [{"part": p, "lang": self.lang, "phrases": zstandard.ZstdCompressor(level=1).compress("\n".join(texts[a:b].to_pylist()).encode()), "counts": _squeezed(counts[a:b])} for p, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())) if b > a]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())]))


def _summed(least: int):
    """The phrases of one language and part that reach the least number over all shards. No word holds a line end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array([t for x in pdf["phrases"] for t in zstandard.ZstdDecompressor().decompress(x).decode().split("\n")], pa.string())
        found = pa.table({"phrase": texts, "f": np.concatenate([_loose(x, np.int64) for x in pdf["counts"]])}).group_by("phrase").aggregate([("f", "sum")])
        found = found.filter(pc.greater_equal(found["f_sum"], least)).to_pandas()
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "phrase": found["phrase"], "f": found["f_sum"]})

    return run


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of one to `longest` words that occur `least` times or more; (lang, n) of all words)."""
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string").cast("binary"))
    base = written(rows.mapInArrow(_base, "shard long, lang string, words array<string>, counts array<long>, size binary, block binary, mask binary"))
    sizes = written(base.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    parts = PARTS + (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // GROUP)
    pairs = base.select("shard", "lang", "words", "size", "block", "mask").mapInArrow(_pairs(parts), "part int, shard long, lang string, hashes binary, counts binary")
    told = pairs.groupBy("part").applyInPandas(_frequent(least), "shard long, lang string, pairs binary").groupBy("shard", "lang").agg(F.collect_list("pairs").alias("pairs"))
    walked = base.select("shard", "lang", "words", "size", "block", "mask").join(told, ["shard", "lang"]).mapInArrow(_phrases(longest, parts), "part int, lang string, phrases binary, counts binary")
    single = base.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("f"))
    single = single.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(single.union(walked.groupBy("lang", "part").applyInPandas(_summed(least), "lang string, phrase string, f long"))), sizes


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of the `first` best phrases of each language.

    Null and empty texts have no words; a null language is `und`. Rows that repeat count each time. Equal scores are
    ordered by a, the larger first, then by the bytes of the phrase. Other columns are not looked at, ids neither. Scores
    are divided as decimals of 38 digits, so products past 64 bits are exact.
    """
    if longest > len(_ODDS):
        raise ValueError(f"phrases of more than {len(_ODDS)} words are not counted")
    known, sizes = frequent_phrases(documents, least, longest, text_col, lang_col)
    words = F.size(F.split("phrase", " "))
    candidates = known.withColumn("words", words).where(F.col("words") > 1)
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), k).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    head, rest = (known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)) for part, name in (("head", "l"), ("rest", "r")))
    cuts = cuts.join(head, ["lang", "head"]).join(rest, ["lang", "rest"]).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
    cuts = cuts.withColumn("score", F.expr("cast(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(15, 0)) as decimal(38, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"))
    scored = scored.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    inside = candidates.where(F.col("words") > 2).withColumn("w", F.split("phrase", " ")).select("lang", "w", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"), "a").distinct()
    left = scored.join(inside, ["lang", "phrase", "a"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in (["lang", "salt"], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= first)
    return left.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
