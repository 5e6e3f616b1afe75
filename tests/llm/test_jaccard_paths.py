"""The Jaccard join's other paths: frequent shingles in ranges of their own, joins by shuffle, ids with several texts."""

import random

import numpy as np
import pytest

from folio.llm import jaccard_join
from folio.llm.common import shingle_hashes

DOCS = "doc_id long, text string, component long, ref string"


def texts(seed=5):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    out = [None, "", "a b", "a  B", " ".join(common)]
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for edits in (0, 0, 1, 2, 5):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w + rng.choice(([], common[:30], common))))
    out.append(" ".join(f"long{i % 7000}" for i in range(30_000)))
    return [*out, out[-1] + " tail"]


def brute(rows):
    """Least id reachable: ids are tied by texts of similarity 0.8 or more, and rows of one id are one node."""
    sets = [set(shingle_hashes(t).tolist()) for _, t in rows]
    label = [i for i, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, label)), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_whole_join(spark, monkeypatch, small):
    if small:
        for name, value in {"LOAD": 3, "PACK": 500, "BROADCAST_IDS": 0, "BROADCAST_SETS": 0, "GROUP": 4, "CROWD": 3, "TRIE_SIZE": 2}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    found = texts()
    rows = [*enumerate(found)]
    rows += [(3, found[6]), (9, found[20]), (9, found[9]), (4, found[4]), (None, found[4]), (None, None), (500, found[7]), (600, None)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS).repartition(3)
    out = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert out == brute(rows)
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _, c in out if i is None or i == c), key=repr)


def test_empty_table(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_trie_takes_fewer_steps_than_pairs():
    """Sets that start alike are compared once as far as they are alike, and left where no overlap can follow."""
    rng = np.random.default_rng(3)
    shared = np.sort(rng.integers(0, 1 << 20, 300, np.uint64))
    members = sorted((np.concatenate([shared, np.sort(rng.integers(1 << 21, 1 << 22, 40, np.uint64))]) for _ in range(50)), key=jaccard_join._bytes)
    apart = sorted((np.sort(rng.integers(0, 1 << 22, 340, np.uint64)) for _ in range(50)), key=jaccard_join._bytes)
    anchor = members[7]
    for some, share in ((members, 0.4), (apart, 0.5)):
        steps: list[int] = []
        needs = [jaccard_join.least_overlap(len(anchor), len(m), 0.8) for m in some]
        found = jaccard_join._walked(anchor, some, needs, steps)
        assert found == [i for i, (m, need) in enumerate(zip(some, needs)) if len(np.intersect1d(anchor, m)) >= need]
        assert sum(steps) <= share * sum(map(len, some))
