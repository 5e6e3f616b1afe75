import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import neural_lm as lm


def rows_of(spark, docs):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, N_TOKENS int").repartition(3)
    return lm.lm_scores(d).collect()


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    tongues = [[f"{c}{rng.choice('aeiou')}{i}" for i in range(300)] for c in "kl"]
    out = [(i, " ".join(rng.choices(tongues[i % 2], [1 / (j + 1) for j in range(300)], k=rng.randint(1, 80)))) for i in range(600)]
    return out + [(5, out[5][1]), (700, None), (701, ""), (702, "Unseen\x0bTHINGS " * 3), (None, "ka1 ka2")]


def test_base_scores_and_counts_equal_plain_ones_and_the_model_is_better(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 100)  # most words are joined
    tokens = {i: (t or "").lower().split() + [""] for i, t in docs}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in (t or "").lower().split() + [""])
    n, v = sum(counts.values()), len(counts)
    found = rows_of(spark, docs)
    assert len(found) == len(docs)
    for r in found:
        mine = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(mine), sum(w in counts for w in mine), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine))
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.05 * sum(r["n_tokens"] for r in out)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) == 1


def test_probabilities_of_all_outputs_and_words_sum_to_one():
    rng = np.random.default_rng(1)
    weight = rng.integers(0, 50, lm.OUTPUTS).astype(float)
    net = lm.Network.new(weight)
    net.q *= 20
    context = rng.integers(0, lm.OUTPUTS + 1, (lm.CONTEXT, 4))
    every = np.array([[net.log_probabilities(context[:, [j]], np.array([o]))[0] for o in range(lm.OUTPUTS)] for j in range(4)])
    assert np.exp(every).sum(1) == pytest.approx(1, abs=1e-4)
    net.b[3] = 200  # sums that overflow are taken again
    assert net.log_probabilities(context, np.array([3, 3, 3, 3])) == pytest.approx(0, abs=1e-6)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    weight = rng.integers(1, 50, lm.OUTPUTS).astype(float)
    net = lm.Network.new(weight)
    log_noise = np.log(lm.noise_of(weight)).astype(np.float32)
    context, output, noise = rng.integers(0, lm.OUTPUTS + 1, (lm.CONTEXT, 50)), rng.integers(0, lm.OUTPUTS, 50), rng.integers(0, lm.OUTPUTS, 8)

    def loss():
        h = net.predicted(context).astype(np.float64)
        data = (h * net.q[output]).sum(1) + net.b[output] - log_noise[output] - np.log(lm.SHARE)
        other = h @ net.q[noise].T + net.b[noise] - log_noise[noise] - np.log(lm.SHARE)
        return np.log1p(np.exp(-data)).mean() + lm.SHARE / len(noise) * np.log1p(np.exp(other)).sum(1).mean()

    for p, g in zip(net.parts(), lm.gradients(net, context, output, noise, log_noise)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.02, abs=1e-4)


def test_contexts_end_with_their_text():
    found = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([2, 3]))
    none = lm.OUTPUTS
    assert found.tolist() == [[none, 1, none, 3, 4], [none, none, none, none, 3]]


def test_an_empty_table_and_one_without_training_documents(spark):
    assert rows_of(spark, []) == []
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = rows_of(spark, [(only, "a b")])[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])


def test_each_context_is_normalised_once_however_many_tokens_follow_it(monkeypatch):
    rng = np.random.default_rng(5)
    net = lm.Network.new(rng.integers(0, 50, lm.OUTPUTS).astype(float))
    net.q *= 10
    context, output = rng.integers(0, lm.OUTPUTS + 1, (lm.CONTEXT, 3000)), rng.integers(0, lm.OUTPUTS, 3000)
    normalised, plain = [], lm.Network.log_sums
    monkeypatch.setattr(lm.Network, "log_sums", lambda self, c: normalised.append(c.shape[1]) or plain(self, c))
    table = lm.Table.of(net)
    assert normalised == [(lm.OUTPUTS + 1) ** lm.CONTEXT]
    for _ in range(3):
        found = table.log_probabilities(context, output)
    assert len(normalised) == 1
    assert found == pytest.approx(net.log_probabilities(context, output), abs=1e-4)


def test_gradients_are_summed_without_sorting_tokens(monkeypatch):
    """Tokens of a batch are added up by their outputs in one pass; sorting them was the dearest part of training."""
    rng = np.random.default_rng(5)
    rows, at = rng.normal(size=(500, lm.WIDTH)).astype(np.float32), rng.integers(0, 7, 500)
    want = np.stack([rows[at == i].astype(np.float64).sum(0) for i in range(9)])
    monkeypatch.setattr(np, "argsort", None)
    found = lm._scattered(rows, at, 9)
    assert found.dtype == np.float32 and np.allclose(found, want, atol=1e-5)
