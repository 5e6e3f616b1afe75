import math
import random
import re
from collections import Counter

import numpy as np

from folio.llm import lexical_search as ls


def plain(docs, items, k=10):
    """Every document scored for every item, by the rule as it is told."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: term.findall((t or "").translate(lower))
    found = [(i, Counter(split(t))) for i, t in docs if i is not None]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def rows_of(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, SCORE string").repartition(3)
    return sorted(tuple(r) for r in ls.ranked_search(d, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_ranks_equal_brute_force_with_ties_repeats_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ls, "DOCS", 64)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["ÄRGER", "Straße", "x-y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(400)]
    docs += [(7, docs[7][1])] * 3 + [(1000 + i, "w1 w2 W3.") for i in range(50)] + [(2000, None), (None, "w1 w2"), (2001, "")]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(0, "w5 w6"), (50, None), (51, "nowhere"), (None, "w1"), (52, "w1 w2 w3")]
    assert rows_of(spark, docs, items) == plain(docs, items)


def test_an_index_of_all_terms_gives_the_same_and_empty_tables_nothing(spark, monkeypatch):
    docs, items = [(i, f"a{i % 7} b{i % 3} c") for i in range(60)], [(1, "a1 b1"), (2, "c")]
    wanted = plain(docs, items)
    monkeypatch.setattr(ls, "ASKED", 0)
    monkeypatch.setattr(ls, "ROUND", 2)
    assert rows_of(spark, docs, items) == wanted
    assert rows_of(spark, [], items) == [] and rows_of(spark, docs, []) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    raw = " ".join(f"Word{i}" for i in range(1000)).encode()
    whole = [t for part in ls.terms_of(raw) for t in part]
    monkeypatch.setattr(ls, "STRETCH", 64)
    assert [t for part in ls.terms_of(raw) for t in part] == whole and len(whole) == 1000


def test_treaps_order_documents_and_impacts_and_subtrees_are_left_unread():
    rng = np.random.default_rng(2)
    n, df = 3000, []
    docs, impacts = [], []
    for size in (1, 2000, 0, 300, 3):
        docs.append(np.sort(rng.choice(n, size, replace=False)))
        impacts.append(rng.integers(1, 50, size))
        df.append(size)
    doc, impact, df = np.concatenate(docs), np.concatenate(impacts), np.array(df)
    left, right, root = ls.treaps(doc, (impact << 16) | ((doc * 40503) & 0xFFFF), df)
    ends = np.cumsum(df)
    for t in range(len(df)):
        seen, stack = [], [(root[t], -1, n)] if df[t] else []
        while stack:
            x, lo, hi = stack.pop()
            assert lo < doc[x] < hi and ends[t] - df[t] <= x < ends[t]
            seen.append(x)
            for child, a, b in ((left[x], lo, doc[x]), (right[x], doc[x], hi)):
                if child < len(doc):
                    assert impact[child] <= impact[x]
                    stack.append((child, a, b))
        assert len(seen) == df[t]
    row = {"ids": np.arange(n), "docs": doc.astype(np.uint16), "impact": impact, "left": left, "right": right, "root": root}
    shard = ls.Shard({k: x.astype({"ids": np.int64, "docs": np.uint16}.get(k, np.int32)).tobytes() for k, x in row.items()} | {"df": df.tolist(), "terms": [*"abcde"]})
    at, w = np.array([0, 1, 3, 4]), np.array([500, 3, 90, 700])
    scores = np.zeros(n, np.int64)
    for t, x in zip(at, w):
        scores[docs[t]] += impacts[t] * x
    best = sorted(zip(-scores, range(n)))[:10]
    found, values, scored = shard.best(at, w, 10)
    assert [*zip((-values).tolist(), found.tolist())] == [(int(s), d) for s, d in best]
    assert scored < n / 4
    found, values, fewer = shard.best(at, w, 10, (int(values[9]), int(found[9])))
    assert len(found) == 10 and fewer <= scored
