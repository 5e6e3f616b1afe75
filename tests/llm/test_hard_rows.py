"""Rows that are hard for the operators: nulls, repeats, clashing columns, long texts, empty tables."""

import random

import numpy as np
import pytest

from folio.llm import bpe, exact_dedup, jaccard_join, quality, token_counts

LONG = " ".join(f"w{i % 977}" for i in range(120_000))
CLASHING = "doc_id long, text string, _id long, _sha string, _own_id long, own_sha string, _gone long, gone string, Score double"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", 2, "b", 3, "c", 0.5) for i, t in rows], CLASHING)


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_of_copies_keep_any_columns(spark, repeated):
    rows = [(1, "a b"), (2, "a  b"), (3, None), (4, ""), (5, LONG), (6, LONG + " ")]
    rows += [(1, "a b"), (2, "c"), (None, "c"), (None, None), (None, "d")] * repeated
    docs = clashing(spark, rows)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    want = [(1, "a b"), (3, None), (5, LONG), (6, LONG + " ")]
    if repeated:
        want += [(2, "c"), (None, "d")]
    assert sorted((tuple(r)[:2] for r in out.collect()), key=repr) == sorted(want, key=repr)
    near = jaccard_join.without_near_copies(docs)
    assert near.columns == docs.columns and exact_dedup.deduplicated(docs.limit(0)).count() == 0
    assert sorted({r["doc_id"] for r in near.collect() if r["doc_id"]}) == ([1, 3, 4, 5] if not repeated else [1, 3, 4, 5])


def test_folding_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(40)}") for i in range(500)]
    whole = sorted(map(tuple, exact_dedup.exact_dedup(clashing(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 500)
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 7)
    assert sorted(map(tuple, exact_dedup.exact_dedup(clashing(spark, rows)).collect())) == whole
    least = {t: min(i for i, x in rows if x == t) for _, t in rows}
    assert [(r[0], r[1]) for r in whole] == [(i, least[t]) for i, t in rows]


def plain_edits(text, edits):
    for _, start, length, new in sorted(edits):
        start = min(max(start, 0), len(text))
        text = text[:start] + new + text[min(start + max(length, 0), len(text)) :]
    return text


@pytest.mark.parametrize("many", [1000, 1])
def test_edits_of_whole_tables(spark, monkeypatch, many):
    """Against the text edited in Python and encoded whole; ids repeat with the same and with other texts."""
    monkeypatch.setattr(token_counts, "MANY", many)
    rng = random.Random(4)
    rows = [(1, "one two three"), (1, "one two three"), (1, "  ünlike 'll\n\n text"), (2, None), (3, ""), (4, LONG[:60_000]), (5, "x" * 3000), (None, "lost")]
    edits = [(i, s, rng.randrange(-2, 3000), rng.randrange(0, 900), rng.choice(("", " new", "é漢\n "))) for i in (1, 2, 4, 5, 9) for s in (2, 1, 3)]
    kind = "doc_id long, seq int, start int, length int, replacement string"
    out = token_counts.edited_token_counts(clashing(spark, rows), spark.createDataFrame([*edits, (None, 1, 0, 0, "x"), (3, 1, None, None, None)], kind))
    got = sorted((r["doc_id"], r["n_tokens"], r["n_edits"], r["n_tokens_edited"], r["n_chars_edited"]) for r in out.collect())
    coder = bpe.vocabulary(bpe.default_vocabulary())
    want = []
    for i, t in rows:
        if i is not None:
            own = [e[1:] for e in edits if e[0] == i] + [(1, 0, 0, "")] * (i == 3)
            after = plain_edits(t or "", own)
            want.append((i, len(coder.encode([t or ""])[0]), len(own), len(coder.encode([after])[0]), len(after)))
    assert got == sorted(want)
    sampled = token_counts.sample_edits(clashing(spark, rows))
    assert sampled.groupBy("doc_id").count().where("count = 3").count() == 5
    empty = clashing(spark, rows).limit(0)
    assert token_counts.edited_token_counts(empty, token_counts.sample_edits(empty)).count() == 0


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    texts = ["a b c d", "c d a b c d e", "", "a b", LONG[:5000], "d e a"]
    encoder = quality.Passages()
    x, sizes = encoder.encode(texts)
    alone = [quality.Passages().encode([t])[0] for t in texts]
    for part, own in zip(np.split(x, np.cumsum(sizes)[:-1]), alone):
        assert np.array_equal(part, own)
