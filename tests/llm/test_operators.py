import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from folio.llm import bpe, exact_dedup, html_extraction, jaccard_join, packing, quality, token_counts, topk_search, toxicity

LETTERS = "ab 's \n\t\x1c é漢字ñ12!?'l\r\xa0😀I'VEΣİ.,"
DOCS = "doc_id long, text string, score int, chunk string"


def texts(n=60, seed=0):
    rng = random.Random(seed)
    return [None, "", "   ", *("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 80))) for _ in range(n))]


def frame(spark, found):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(found)], DOCS)


def test_bpe_is_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = [*texts(300), "ab" * 20000]
    rows = {r["doc_id"]: r for r in bpe.round_trip_digests(frame(spark, found)).collect()}
    for i, t in enumerate(found):
        ids = own.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_packing_keeps_every_id(spark):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = [*texts(100), "Word, word. " * 4000]
    want = [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in found]
    rows = packing.pack(frame(spark, found)).collect()
    for r in rows:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 2048 for n in list(used.values())[:-1])
    assert packing.pack(frame(spark, ["x"]).limit(0)).count() == 0


def test_exact_dedup(spark):
    found = ["a  b", "a b", None, "", "a\tb", " ", "c"]
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, found)).collect()}
    assert rows == {0: (0, 3, True), 1: (0, 3, False), 2: (2, 2, True), 3: (2, 2, False), 4: (0, 3, False), 5: (5, 1, True), 6: (6, 1, True)}
    kept = exact_dedup.deduplicated(frame(spark, found))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 5, 6] and kept.columns == ["doc_id", "text", "score", "chunk"]


def test_grace_spills(tmp_path):
    contents = [bytes([i % 50]) * 500 for i in range(400)]
    records = [("c", i, hash(t) & (2**62 - 1), t, i, 1) for i, t in enumerate(contents)]
    rows = [r for b in exact_dedup._bucket(iter(records), 0, str(tmp_path), most=4000) for r in b.to_pylist()]
    assert sorted((r["slot"], r["keep_id"], r["group_size"]) for r in rows) == [(i, i % 50, 8) for i in range(400)]
    assert not list(tmp_path.iterdir())


def test_jaccard_components(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(60)) for _ in range(6)]
    found = [None, "", "one two", "One  two", *base]
    for b in base:
        w = b.split()
        for k in (1, 3, 6):
            found.append(" ".join([*w[:k], "new", *w[k + 1 :]]))
    sets = []
    for t in found:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(found)))
    for _ in found:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, found)).collect()}
    assert rows == {i: (len(sets[i]), label[i]) for i in range(len(found))}


def test_token_counts_follow_edits(spark):
    coder, rng = bpe.vocabulary(bpe.default_vocabulary()), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 4000)))
        (tree,) = token_counts.SegmentTree.of([text], lambda some: [len(x) for x in coder.encode(some)])
        for _ in range(6):
            start, length, new = rng.randint(0, len(text) + 2), rng.randint(0, 900), "".join(rng.choice(LETTERS) for _ in range(rng.choice((0, 3, 6000))))
            tree.edit(start, length, new, coder.counts)
            text = text[:start] + new + text[start + length :]
            assert tree.text() == text and tree.tokens[1] == len(coder.encode([text])[0])
    docs = frame(spark, ["a b c", None])
    out = {r["doc_id"]: r["n_tokens_edited"] for r in token_counts.edited_token_counts(docs, spark.createDataFrame([(0, 1, 0, 2, ""), (9, 1, 0, 0, "x")], "doc_id long, seq int, start int, length int, replacement string")).collect()}
    assert out == {0: 2, 1: 0}


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.integers(-3, 3, 8).astype(float).tolist() for _ in range(300)]
    vectors[7], vectors[8], vectors[9] = None, [float("nan")] * 8, [1.0, None, *[0.0] * 6]
    rows = topk_search.top_k(spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, rank string")).collect()
    ok = [i for i in range(300) if i not in (7, 8, 9)]
    want = []
    for q in range(0, 300, 50):
        s = sorted((-int(np.dot(np.floor(256 * np.array(vectors[q])), np.floor(256 * np.array(vectors[i])))), i) for i in ok if i != q)
        want += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s[:5])]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_html(spark):
    body = "<h1>T&eacute;</h1><p>One <b>tw</b>o<br>three<p>four<div class=share>no</div><section id=comments><p>bad</p></section>"
    page = f"<body><header>x</header><nav><a>m</a></nav><article class=p1>{body}</article><form>f</form><footer>z</footer>"
    rows = html_extraction.main_texts(spark.createDataFrame([(1, "http://a.b/c", page), (2, None, page), (3, "http://a.b/d", None)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {1: "Té One two three four", 2: "Té One two three four", 3: ""}


@pytest.mark.parametrize("score,label,least", [(quality.quality, "quality", 0.95), (toxicity.toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    empty = score(docs.limit(0), labels.limit(0))
    assert empty.count() == 0
    assert [r["score"] for r in score(docs.limit(3), labels.limit(0)).collect()] == [0.5] * 3
