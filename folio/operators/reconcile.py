"""Comparison of two parses of one act."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_text


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(citation, status, first_id, second_id, first_text, second_text) of node tables (citation, seq, node_id, heading, text) that meet by citation.

    status is first_only, second_only, identical or different; texts are headings and texts, compared in normal form. Of
    nodes with one citation the last of each side counts.
    """

    def side(nodes: DataFrame, name: str) -> DataFrame:
        text = F.trim(F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit(""))))
        last = nodes.groupBy("citation").agg(F.max_by(F.struct("node_id", text.alias("text")), "seq").alias("n"))
        return last.select("citation", F.col("n.node_id").alias(f"{name}_id"), F.col("n.text").alias(f"{name}_text"))

    both = side(first, "first").join(side(second, "second"), "citation", "full")
    same = normal_text(F.col("first_text")) == normal_text(F.col("second_text"))
    status = F.when(F.col("second_id").isNull(), "first_only").when(F.col("first_id").isNull(), "second_only").when(same, "identical").otherwise("different")
    return both.select("citation", status.alias("status"), "first_id", "second_id", "first_text", "second_text")


def comparison_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: numbers of nodes of each side, shared, of one side only, identical and different."""
    count = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    return compared(first, second).agg(
        count("first_only", "identical", "different").alias("first_nodes"), count("second_only", "identical", "different").alias("second_nodes"),
        count("identical", "different").alias("shared"), count("first_only").alias("first_only"), count("second_only").alias("second_only"),
        count("identical").alias("identical"), count("different").alias("different"),
    )
