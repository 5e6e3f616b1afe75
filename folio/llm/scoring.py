"""What the learnt classifiers share: logistic calibration, base rates, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, slices


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def fitted_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def base_rate(labels: DataFrame, label: str, id_col: str = "doc_id") -> float | None:
    """Share of label 1 among labels outside the held-out fifth; None where only one class or none is known."""
    n, ones = labels.where(F.col(label).cast("int").isin(0, 1) & ~held_out(id_col)).agg(F.count("*"), F.sum(F.col(label).cast("int"))).first()
    return ones / n if n and 0 < ones < n else None


def shifted(sample: np.ndarray, rate: float) -> float:
    """What to add to a logit that was fitted on a sample of other class shares than the whole table's."""
    return logit(rate) - logit(float(np.mean(sample)))


def scored(df: DataFrame, text_col: str, scorer: Callable[[], Callable[[list[str]], np.ndarray]], score_col: str) -> DataFrame:
    """df with a score of each row's whole text. scorer() runs once in each task and gives the function of texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).cast(pa.string()).to_pylist()]
            found = [score(texts[lo:hi]) for lo, hi in slices([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*found, np.zeros(0)]))], [*batch.schema.names, score_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(score_col, DoubleType())]))


def report(documents: DataFrame, id_col: str, text_col: str, scorer, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Other columns are not read."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = scored(docs, "text", scorer, "score").drop("text")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(documents: DataFrame, text_col: str, scorer, keep) -> DataFrame:
    """Rows of documents, with all their columns, whose score passes keep(column)."""
    name = "score"
    while name in documents.columns:
        name = f"_{name}"
    return scored(documents, text_col, scorer, name).where(keep(F.col(name))).drop(name)
