"""Readers of the test tables, and articles, paragraphs and points of a synthetic act."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, paragraph_id): the orders of a customer are the paragraphs of an article."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.col("o_orderkey").alias("paragraph_id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paragraph_id, number, text): the lines of an order are the points of a paragraph, told as sentences."""
    modal = F.when(F.col("l_returnflag") == "A", "shall").when(F.col("l_returnflag") == "N", "may").otherwise("must")
    text = F.concat(F.lit("The supplier "), modal, F.lit(" deliver "), F.col("l_quantity").cast("int").cast("string"), F.lit(" units within "), F.col("l_linenumber").cast("string"), F.lit(" days"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paragraph_id"), F.col("l_linenumber").cast("int").alias("number"), text.alias("text"))


def act_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles with paragraphs, the paragraphs and the points as nodes: article_id, local_id, heading, node_id, parent_id, seq, n_chars.

    Headings are not told, and paragraphs have no text of their own. Points of a paragraph with the same number keep the order of their text.
    """
    none = F.lit(None).cast("string")
    over = paragraphs(spark, sf_dir)
    article, paragraph = F.concat(F.lit("art_"), F.col("article_id")), F.concat(F.lit("art_"), F.col("article_id"), F.lit(".par_"), F.col("paragraph_id"))
    roots = over.select("article_id").distinct().select("article_id", F.col("article_id").cast("string").alias("local_id"), none.alias("heading"), article.alias("node_id"), none.alias("parent_id"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("n_chars"))
    middle = over.select("article_id", none, none, paragraph, article, F.col("paragraph_id").cast("long"), F.lit(0))
    below = points(spark, sf_dir).withColumn("copy", F.row_number().over(Window.partitionBy("paragraph_id").orderBy("number", "text"))).join(over, "paragraph_id")
    below = below.select("article_id", none, none, F.concat(paragraph, F.lit(".pt_"), F.col("copy")), paragraph, F.col("copy").cast("long"), F.length("text"))
    return roots.union(middle).union(below)
