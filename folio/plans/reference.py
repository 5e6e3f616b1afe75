"""Queries of the library's own operators over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import integrity, signals, units
from ..sources import tables


def unit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_plan(units.subtree_sizes(tables.paragraphs(spark, sf_dir), tables.points(spark, sf_dir)))


def unit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all units of unit_plan's articles. It has no SQL: tests hold it against the reference's rules."""
    return units.unit_pack(tables.act_nodes(spark, sf_dir))


def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.subtree_sizes(tables.paragraphs(spark, sf_dir), tables.points(spark, sf_dir))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_ids(tables.points(spark, sf_dir), "paragraph_id", "number")


def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.numbering_gaps(tables.points(spark, sf_dir), "paragraph_id", "number")


def modal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic act also says `must`, which the library does not count by itself but the query's SQL does."""
    return signals.modal_counts(tables.points(spark, sf_dir), modals=[*signals.MODALS, "must"])


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.duration_counts(tables.points(spark, sf_dir))


def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.source_hash(F.col("text")).alias("source_hash"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", text.title(F.col("html")).alias("title"))


def kleene_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued conditions over labels that many documents lack: true, false or unknown."""
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = tables.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    both, either = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("quality") == 1) | (F.col("doc_id") % 2 == 0)
    return joined.select("doc_id", both.alias("all_of"), either.alias("any_of"), (~both).alias("not_of"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (unit_plan, subtree_sizes, duplicate_ids, numbering_gaps, modal_counts, durations, source_hash, page_titles, kleene_eval)}

#: Queries whose recursion has no equal in SQL.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {"unit_pack": unit_pack}

_POINTS = """points AS (
    SELECT l_orderkey AS paragraph_id, CAST(l_linenumber AS INTEGER) AS number, 'The supplier ' || CASE l_returnflag WHEN 'A' THEN 'shall' WHEN 'N' THEN 'may' ELSE 'must' END
        || ' deliver ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' units within ' || CAST(l_linenumber AS VARCHAR) || ' days' AS text
    FROM lineitem)"""
_SIZES = f"""{_POINTS}, b AS (SELECT paragraph_id, count(*) AS points, sum(length(text)) AS chars FROM points GROUP BY 1),
    sizes AS (SELECT o_custkey AS article_id, CAST(count(*) + sum(coalesce(points, 0)) + 1 AS BIGINT) AS n_nodes, CAST(sum(coalesce(chars, 0)) AS BIGINT) AS n_chars
        FROM orders LEFT JOIN b ON o_orderkey = paragraph_id GROUP BY 1)"""

ORACLE_SQL: dict[str, str] = {
    "unit_plan": f"WITH {_SIZES} SELECT article_id, n_chars, n_chars <= 1500 AS whole FROM sizes",
    "subtree_sizes": f"WITH {_SIZES} SELECT article_id, n_nodes, n_chars FROM sizes",
    "duplicate_ids": f"WITH {_POINTS} SELECT paragraph_id, number, count(*) AS copies FROM points GROUP BY 1, 2 HAVING count(*) > 1",
    "numbering_gaps": f"""WITH {_POINTS}, k AS (SELECT DISTINCT paragraph_id, number AS before FROM points),
        g AS (SELECT *, coalesce(lag(before) OVER (PARTITION BY paragraph_id ORDER BY before), 0) AS after FROM k)
        SELECT paragraph_id, after, before, before - after - 1 AS missing FROM g WHERE before - after > 1""",
    "modal_counts": f"WITH {_POINTS}, m AS (SELECT unnest(regexp_extract_all(text, '\\b(shall not|may not|shall|must|may)\\b', 1)) AS modal FROM points) SELECT modal, count(*) AS n FROM m GROUP BY 1",
    "durations": f"WITH {_POINTS}, m AS (SELECT unnest(regexp_extract_all(text, '\\bwithin (\\d+) (hours?|days?|months?|years?)\\b')) AS match FROM points) SELECT match, count(*) AS n FROM m GROUP BY 1",
    "source_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS source_hash FROM documents",
    "page_titles": "SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages",
    "kleene_eval": """SELECT d.doc_id, quality = 1 AND toxic = 0 AS all_of, quality = 1 OR d.doc_id % 2 = 0 AS any_of, NOT (quality = 1 AND toxic = 0) AS not_of
        FROM documents d LEFT JOIN labels USING (doc_id)""",
}
