"""Quality by attention-based multiple-instance learning: a document is a bag of passages with one label.

Every passage of WIDTH words is encoded by what its words look like (letters, case, digits, signs, lengths) and
how much of it repeats the document before. A small network embeds the passages; gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs them; a logistic unit scores the weighted mean. Embedding,
attention and score are learnt together from document labels alone, by gradient descent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Memo, labelled_sample, mix, ragged
from .scoring import base_rate, kept, report, shifted, sigmoid

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 4000
WIDTH = 64
HIDDEN, GATE, STEPS, RATE = 16, 8, 400, 0.02
THRESHOLD = 0.3
#: Classes of characters that are counted in each word.
_KINDS = [re.compile(p) for p in (r"[A-Z]", r"[a-z]", r"[0-9]", r"[^\x00-\x7f]", r"!", r"[?]", r"[.,;:]", r"[*#$%&+=~^|\\/_<>@{}\[\]]", r"[-'\"()]")]
_WORD_FEATURES = len(_KINDS) + 4
FEATURES = _WORD_FEATURES + 4


def _word(w: str) -> list[float]:
    counts = [len(k.findall(w)) for k in _KINDS]
    return [*counts, len(w), float(w.isupper()), float(len(w) == 1), float(len(w) > 20)]


class Passages:
    """Encodes texts as passages of features."""

    def __init__(self):
        self.memo = Memo(lambda new: [_word(w) for w in new], np.float32, 200_000)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features of all passages in order, passages of each text). A text without words has one passage of zeros."""
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = [w for some in split for w in some]
        at = self.memo.at(flat)
        vectors = self.memo.data[ragged(self.memo.start[at], np.full(len(at), _WORD_FEATURES))].reshape(-1, _WORD_FEATURES)
        passages = np.maximum(1, -(-n // WIDTH))
        out = np.zeros((int(passages.sum()), FEATURES), np.float32)
        if not len(flat):
            return out, passages
        doc = np.repeat(np.arange(len(n)), n)
        within = ragged(np.zeros(len(n), np.int64), n)
        passage = (np.cumsum(passages) - passages)[doc] + within // WIDTH
        size = np.bincount(passage, minlength=len(out)).astype(np.float32)
        some = np.maximum(size, 1)[:, None]
        for k in range(_WORD_FEATURES):
            out[:, k] = np.bincount(passage, vectors[:, k], len(out))
        length = np.maximum(out[:, len(_KINDS)], 1)[:, None].copy()
        out[:, : len(_KINDS)] = np.sqrt(out[:, : len(_KINDS)] / length)
        out[:, len(_KINDS) : _WORD_FEATURES] /= some
        out[:, len(_KINDS)] /= 10
        runs = self._repeated(at, doc)
        out[:, -4] = np.bincount(passage, self._again(mix(at.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32)))), len(out)) / some[:, 0]
        out[:, -3] = np.bincount(passage, runs, len(out)) / some[:, 0]
        out[:, -2] = np.log1p(size) / 4
        out[:, -1] = np.log1p(n)[np.repeat(np.arange(len(n)), passages)] / 8
        return out, passages

    def _repeated(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """1 for a word that starts a run of three words which its document had before; runs end with their document."""
        h = mix(at.astype(np.uint64) + np.uint64(1))
        out, starts = np.zeros(len(h)), np.flatnonzero(doc[2:] == doc[:-2])
        three = (h[starts] * np.uint64(31) + h[starts + 1]) * np.uint64(37) + h[starts + 2]
        out[starts] = self._again(mix(three + mix(doc[starts].astype(np.uint64))))
        return out

    @staticmethod
    def _again(keys: np.ndarray) -> np.ndarray:
        _, first = np.unique(keys, return_index=True)
        out = np.ones(len(keys))
        out[first] = 0
        return out


@dataclass
class Model:
    """Parameters of the network, mean and spread of the features, and what calibration adds to the logit."""

    p: dict[str, np.ndarray] | None = None
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    shift: float = 0.0

    def scorer(self):
        if self.p is None:
            return lambda texts: np.full(len(texts), 0.5)
        passages = Passages()

        def score(texts: list[str]) -> np.ndarray:
            x, sizes = passages.encode(texts)
            return sigmoid(forward(self.p, (x - self.mean) / self.spread, sizes)["out"] + self.shift)

        return score


def forward(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Logits ("out") of bags of passages, with what the gradients need."""
    starts = np.cumsum(sizes) - sizes
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ p["E"] + p["e"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    s = (v * u) @ p["w"]
    a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"bag": bag, "starts": starts, "h": h, "v": v, "u": u, "a": a, "z": z, "out": z @ p["c"] + p["d"][0]}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over bags."""
    f = forward(p, x, sizes)
    bag, h, v, u, a = (f[k] for k in ("bag", "h", "v", "u", "a"))
    g = (sigmoid(f["out"]) - y) / len(y)
    dz = g[:, None] * p["c"]
    da = (dz[bag] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, f["starts"])[bag])
    dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
    dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": ((v * u) * ds[:, None]).sum(0), "c": f["z"].T @ g, "d": np.array([g.sum()])}


def trained(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam from a fixed start; the learning rate falls to nothing."""
    rng = np.random.default_rng(6)
    shapes = {"E": (x.shape[1], HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, shape[0] ** -0.5, shape) if k not in "ed" else np.zeros(shape) for k, shape in shapes.items()}
    m, q = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        for k, g in gradients(p, x, sizes, y).items():
            g = g + decay * p[k]
            m[k], q[k] = 0.9 * m[k] + 0.1 * g, 0.999 * q[k] + 0.001 * g * g
            p[k] = p[k] - rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
    return p


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    passages = Passages()
    for pdf in batches:
        for lo in range(0, len(pdf), 256):
            some = pdf[lo : lo + 256]
            x, sizes = passages.encode(some["text"].tolist())
            yield pd.DataFrame({"y": some["y"], "x": [part.tobytes() for part in np.split(x, np.cumsum(sizes)[:-1])]})


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled documents outside the held-out fifth. With one class or none known, every score is one half."""
    rate = base_rate(labels, "quality", id_col)
    if rate is None:
        return Model()
    rows = labelled_sample(documents, labels, "quality", sample, id_col, text_col).mapInPandas(_encoded, "y int, x binary").collect()
    if len({r["y"] for r in rows}) < 2:
        return Model()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # the order of arrival must not matter
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    x, sizes, y = np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), np.array([r["y"] for r in rows], np.float64)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    return Model(trained((x - mean) / spread, sizes, y), mean, spread, shifted(y, rate))


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3) of every row.

    Null text counts as empty: one passage of zeros. Rows are scored one by one, so repeated rows and ids do
    no harm; a null id is not held out. Without labels of both classes every score is one half.
    """
    return report(documents, id_col, text_col, fit(documents, labels, id_col, text_col).scorer, THRESHOLD)


def of_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents, with all their columns, that the classifier accepts. Without labels of both classes all stay."""
    model = fit(documents, labels, id_col, text_col)
    return documents if model.p is None else kept(documents, text_col, model.scorer, lambda score: score >= THRESHOLD)
