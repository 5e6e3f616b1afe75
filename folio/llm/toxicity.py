"""Toxicity by compression distance: windows are shorter under the zstandard dictionary of the text they resemble.

Two dictionaries are put together from words of labelled documents, one of ordinary and one of toxic text; they
stand in for dictionaries that zstandard trains on text, which told the classes apart badly (README). Both hold the
words that are frequent in any text; each also holds the words that are typical of its own class. zstandard
pays about three bytes for a match, as much as for a short word, so words are compressed as codes: the first
letters, fixed bytes drawn from them, the rest, and fixed bytes drawn from the whole word. A known word is then
one long match, a known stem half of one, and any other word costs the same under both.

Every window of a text is compressed whole under both; its distance is its length under the ordinary dictionary less
that under the toxic one. A document's score comes from its largest window and its totals, through a logistic
calibration fitted on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .common import labelled_sample
from .scoring import base_rate, fitted_logistic, kept, report, shifted, sigmoid

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 6000
WINDOW, STEM, LEVEL = 8, 5, 3
FREQUENT = 1500
#: A word is typical of a class that has it in this share of documents at least, so many times more often than the
#: other, and between different neighbours as often: the words of one text that has many copies are not typical.
TYPICAL_SHARE, TYPICAL_RATIO = 0.01, 20
#: Bytes by which a window must be shorter under the toxic dictionary to count as a hit: by a stem, by a whole word.
STEM_HIT, HIT = 3, 8
THRESHOLD = 0.5
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str) -> list[bytes]:
    """Lower-case runs of letters, in UTF-8."""
    return _WORD.findall(text.lower().encode())


def code(word: bytes) -> bytes:
    stem = word[:STEM]
    return stem + xxhash.xxh3_64_digest(stem)[:6] + word[STEM:] + xxhash.xxh3_64_digest(word)


class Counts:
    """Of each class: documents that have a word, and places of a word, told apart by the words beside it."""

    def __init__(self):
        self.documents, self.places = (Counter(), Counter()), (set(), set())

    def add(self, found: list[bytes], y: int) -> None:
        self.documents[y].update(set(found))
        self.places[y].update(zip(found, [b"", *found], [*found[1:], b""]))

    def typical(self, y: int, n: list[int]) -> list[bytes]:
        own, other, places = self.documents[y], self.documents[1 - y], Counter(p[0] for p in self.places[y])
        least = max(3, TYPICAL_SHARE * n[y])
        found = [w for w, c in own.items() if min(c, places[w]) >= least and c / n[y] > TYPICAL_RATIO * (other[w] + 0.5) / n[1 - y]]
        return sorted(found, key=lambda w: (own[w], w))


@dataclass
class Model:
    """ordinary and toxic: contents of the two dictionaries; weights of the calibration, or None with a constant logit."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None
    constant: float = 0.0

    def scorer(self):
        """A function from texts to scores; it holds the compressors, so it is made anew in each task."""
        if self.weights is None:
            return lambda texts: np.full(len(texts), sigmoid(np.array(self.constant)))
        distances = Distances(self)
        return lambda texts: sigmoid(np.column_stack([distances.features(texts), np.ones(len(texts))]) @ self.weights)


class Distances:
    def __init__(self, model: Model):
        kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in kinds]
        self.codes: dict[bytes, bytes] = {}

    def windows(self, text: str) -> list[bytes]:
        """The codes of each WINDOW words of a text, put together; the last window may have fewer."""
        found = words(text)
        if len(self.codes) > 300_000:  # kept for the words met before
            self.codes.clear()
        for w in set(found).difference(self.codes):
            self.codes[w] = code(w)
        coded = [*map(self.codes.__getitem__, found)]
        return [b"".join(coded[i : i + WINDOW]) for i in range(0, len(coded), WINDOW)]

    def of(self, windows: list[bytes]) -> np.ndarray:
        """By how many bytes each window is shorter under the toxic dictionary."""
        ordinary, toxic = (c.compress for c in self.compressors)
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows), np.int64, len(windows))

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: its largest distance, what its windows are shorter by in all and by window, and what stems alone add; as logarithms."""
        out = np.zeros((len(texts), 4))
        for row, text in zip(out, texts):
            d = self.of(self.windows(text))
            if len(d):
                hit, stem = d[d >= HIT], d[(d >= STEM_HIT) & (d < HIT)]
                row[:] = hit.max(initial=0), hit.sum() / HIT, 100 * hit.sum() / (HIT * WINDOW * len(d) + 10), 100 * len(stem) / (len(d) + 10)
        return np.log1p(out)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled documents outside the held-out fifth. With one class or none known, every score is one half."""
    rate = base_rate(labels, "toxic", id_col)
    rows = labelled_sample(documents, labels, "toxic", sample, id_col, text_col).collect() if rate else []
    rows = sorted(((r["text"], r["y"]) for r in rows), key=lambda r: (xxhash.xxh3_64_intdigest(r[0].encode("utf-8", "replace")), r[1]))
    train, tune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    n = [sum(y == k for _, y in train) for k in (0, 1)]
    if not all(n) or len({y for _, y in tune}) < 2:
        return Model()
    counted = Counts()
    for text, y in train:
        counted.add(words(text), y)
    counts = counted.documents
    own = [counted.typical(y, n) for y in (0, 1)]
    both = {w: min(counts[0][w] / n[0], counts[1][w] / n[1]) for w in counts[0].keys() & counts[1].keys() - {*own[0], *own[1]}}
    shared = sorted(both, key=lambda w: (both[w], w))[-FREQUENT:]
    model = Model(*(b"".join(map(code, [*shared, *own[y]])) for y in (0, 1)))
    y = np.array([y for _, y in tune], np.float64)
    model.weights = fitted_logistic(Distances(model).features([t for t, _ in tune]), y)
    model.weights[-1] += shifted(y, rate)
    return model


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every row.

    Null text counts as empty and gets the score of a text without words. Rows are scored one by one, so
    repeated rows and ids do no harm; a null id is not held out. Without labels of both classes every score is one half.
    """
    return report(documents, id_col, text_col, fit(documents, labels, id_col, text_col).scorer, THRESHOLD)


def without_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents, with all their columns, but those that the classifier holds to be toxic. Without labels of both classes all stay."""
    model = fit(documents, labels, id_col, text_col)
    return documents if model.weights is None else kept(documents, text_col, model.scorer, lambda score: score < THRESHOLD)
