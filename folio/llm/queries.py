"""The queries of the training-data operators: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extraction, jaccard_join, lexical_search, license_scan, neural_lm, packing, phrases, quality, token_counts, topk_search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return token_counts.edited_token_counts(documents, token_counts.sample_edits(documents))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(_table(spark, sf_dir, "pages"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_byte_bpe, op3_token_counts, op4_license_scan, op5_toxicity, op6_quality_classifier, op7_html_extraction, op8_topk_search, op9_exact_dedup, op10_packing, op11_lexical_search, op12_lm_scores, op13_phrase_collocations)
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh
            FROM w WHERE len(ws) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        ), k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id
        FROM documents d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_topk_search": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM e q JOIN e c ON q.i = c.i AND q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op11_lexical_search": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
        ), d AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
        c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), o AS (SELECT doc_id, n, unnest(ts) AS term FROM d),
        p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, big_n),
        s AS (
            SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * c.big_n) // c.big_l)))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY 1, 2
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_phrase_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase
            FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k
        ), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
        cut AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS j FROM c),
        s AS (
            SELECT cut.lang, cut.phrase, cut.a, cut.j, x.f AS l, y.f AS r, n.n, (1000 * cut.a::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
            FROM cut JOIN n USING (lang)
            JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[1:cut.j], ' ')
            JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[cut.j+1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, cut.j) = 1
        ), o AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS m FROM c),
        i AS (SELECT DISTINCT lang, a, unnest(list_transform(range(1, k - m + 2), lambda b: array_to_string(ws[b:b+m-1], ' '))) AS phrase FROM o)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
            CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM s ANTI JOIN i USING (lang, a, phrase) QUALIFY rank <= 2000""",
}
