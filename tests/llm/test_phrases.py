import random
import re
from collections import Counter

import numpy as np

from folio.llm import phrases


def plain(docs, least, longest=5, first=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, out = {}, []
    for text, lang in docs:
        mine = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                mine.update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for lang, mine in f.items():
        n = sum(c for p, c in mine.items() if " " not in p)
        inside = {(" ".join(ws[i : i + m]), c) for p, c in mine.items() if c >= least for ws in [p.split(" ")] for m in range(2, len(ws)) for i in range(len(ws) - m + 1)}
        rows = []
        for p, a in mine.items():
            ws = p.split(" ")
            if len(ws) > 1 and a >= least and (p, a) not in inside:
                cuts = [(1000 * a * n // (mine[" ".join(ws[:k])] * mine[" ".join(ws[k:])]), k) for k in range(1, len(ws))]
                score, k = min(cuts)
                rows.append((-score, -a, p.encode(), mine[" ".join(ws[:k])], mine[" ".join(ws[k:])]))
        out += [(lang, r, p.decode(), -a, l, right, n, -s) for r, (s, a, p, l, right) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def rows_of(spark, docs, least, **kw):
    d = spark.createDataFrame([(t, lang, 0) for t, lang in docs], "text string, lang string, RANK int").repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(d, least, **kw).collect())


def test_equal_to_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)] + ["Ärger", "ÄRGER", "a\x00b", "-"]
    said = [" ".join(rng.choices(words, k=4)) for _ in range(6)]
    docs = []
    for i in range(300):
        bits = [rng.choice(said) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        docs.append(("".join(b + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for b in bits), rng.choice(["en", "de", None, ""])))
    docs += [("x x x x x x x x", "en")] * 20 + [(None, "en"), ("", None), ("...", "fr"), ("One", "it")]
    wanted = plain(docs, 12)
    assert rows_of(spark, docs, 12) == wanted and len(wanted) > 20
    assert rows_of(spark, docs, 12, first=3) == plain(docs, 12, first=3)
    assert rows_of(spark, docs, 12, longest=2) == plain(docs, 12, 2)
    assert rows_of(spark, [], 1) == []


def test_bitmaps_extend_over_blocks_and_not_over_pieces():
    rng = np.random.default_rng(0)
    at = rng.integers(-1, 4, 5000).astype(np.int32)
    maps = phrases.Bitmaps.of(at)
    assert maps.counts(4).tolist() == [int((at == w).sum()) for w in range(4)]
    for some in maps.chunks():
        phrase, word, _, mask = maps.extended(maps.word[some], maps.block[some], maps.mask[some])
        keys, bits, _ = phrases.grouped(phrase, word, mask, 4)
        assert {int(k): int(b) for k, b in zip(keys, bits)} == {a * 4 + b: n for a in range(4) for b in range(4) if (n := int(((at[:-1] == a) & (at[1:] == b)).sum()))}


def test_long_texts_keep_their_pieces(monkeypatch):
    raw = ("alpha beta, gamma " * 300).encode()
    whole = [w for part in phrases.words_of(raw) for w in part]
    monkeypatch.setattr(phrases, "STRETCH", 40)
    assert [w for part in phrases.words_of(raw) for w in part] == whole and whole.count(b".") == 300
