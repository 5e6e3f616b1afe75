import random

import numpy as np
import pytest

from folio.llm import jaccard_join
from folio.llm.common import shingle_hashes

DOCS = "doc_id long, text string"


def brute(texts, similarity=0.8):
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            low = min(label[i], label[j])
            moved |= label[i] != label[j]
            label[i] = label[j] = low
    return dict(enumerate(label))


def forms(n=90, seed=4):
    """Texts on one template, with a tenth to a quarter of own shingles, of two lengths, some of them near copies."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = list(template[: rng.choice((70, 80, 120))])
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"own{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("crowd", [0, 5, 256])
def test_forms_on_one_template(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    texts = forms()
    rows = jaccard_join.jaccard_components(spark.createDataFrame([*enumerate(texts)], DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute(texts)


def test_blocks_give_all_links_but_no_pairs(spark):
    """Every group is two blocks at most: before, the rows of one key met in one task and left it as pairs."""
    texts = forms(60)
    keys = [jaccard_join.ordered_keys(shingle_hashes(t), np.zeros(len(shingle_hashes(t)))) for t in texts]
    sets = spark.createDataFrame([(i, len(own), bytearray(own.tobytes())) for i, own in enumerate(keys)], "doc long, n int, keys binary")
    tokens = [(int(k.view(np.int64)), i, len(own), i) for i, own in enumerate(keys) for k in own[: jaccard_join.prefix_length(len(own), 0.8)]]
    rows = spark.createDataFrame(tokens, "token long, doc long, n int, comp long")
    links = [tuple(r) for r in jaccard_join.crowded_links(sets, rows, 0.8, block=16).collect()]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(enumerate(label)) == brute(texts)
