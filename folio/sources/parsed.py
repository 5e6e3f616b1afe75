"""Parsed documents as JSON texts: node tables are written as such, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import by_document

_NODE = "id string, ptype string, local_id string, citation string, parent string, heading string, text string, is_normative boolean, marker string, children array<string>"


def _none(c: Column) -> Column:
    """A null of the type of c."""
    return F.when(F.lit(False), c)


def rendered(documents: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """(doc_id, json): one text for each of documents (doc_id, document struct) with its report (doc_id, errors, sequence_errors, ..) and its nodes in order.

    Nodes: doc_id, node_id, seq, ptype, local_id, citation, parent_id, heading, text, is_normative, marker, ordinal. Null headings, texts and markers are
    written as empty; a null parent is written, other nulls of a document are not. A document without a report has one of empty lists; all nodes of a document are in one row.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    own = F.struct("seq", "ptype", "local_id", "citation", "parent_id", "heading", "text", "is_normative", "marker")
    # A document's nodes meet once: each is told under its own id and, as a child, under its parent's.
    child = F.struct("ordinal", "seq", "node_id")
    told = F.struct("node_id", own.alias("own"), _none(child).alias("child")), F.struct(F.col("parent_id").alias("node_id"), _none(own).alias("own"), child.alias("child"))
    each = by_document(nodes).select("doc_id", F.inline(F.array(*told))).where("own is not null or node_id is not null")
    whole = each.groupBy("doc_id", "node_id").agg(F.collect_list("own").alias("own"), F.transform(F.sort_array(F.collect_list("child")), lambda x: x["node_id"]).alias("children"))
    whole = whole.select("doc_id", "node_id", "children", F.inline("own"))
    node = F.to_json(F.struct(F.col("node_id").alias("id"), "ptype", "local_id", "citation", F.col("parent_id").alias("parent"), empty("heading"), empty("text"), F.coalesce("is_normative", F.lit(False)).alias("is_normative"), empty("marker"), "children"), {"ignoreNullFields": "false"})
    lists = whole.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "node_id", node.alias("node")))), lambda x: x["node"]), ",").alias("nodes"))
    told = reports.select("doc_id", F.to_json(F.struct(*(c for c in reports.columns if c != "doc_id"))).alias("report"))
    rows = documents.join(lists, "doc_id", "left").join(told, "doc_id", "left")
    report = F.coalesce("report", F.lit('{"errors":[],"sequence_errors":[]}'))
    return rows.select("doc_id", F.concat(F.lit('{"document":'), F.to_json("document"), F.lit(',"report":'), report, F.lit(',"nodes":['), F.coalesce("nodes", F.lit("")), F.lit("]}")).alias("json"))


def saved(texts: DataFrame, folder: str) -> None:
    """Write the JSON of (doc_id, json), one document a line."""
    texts.select("json").write.mode("overwrite").text(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, json) of what was saved; doc_id is null where a text tells none."""
    return spark.read.text(folder).select(F.get_json_object("value", "$.document.id").alias("doc_id"), F.col("value").alias("json"))


def unreadable(texts: DataFrame) -> DataFrame:
    """(doc_id) of texts that are no object with an object `document`."""
    return texts.where(~F.coalesce(F.startswith(F.ltrim(F.get_json_object("json", "$.document")), F.lit("{")), F.lit(False))).select("doc_id")


def nodes(texts: DataFrame) -> DataFrame:
    """(doc_id, node_id, seq, ptype, local_id, citation, parent_id, heading, text, is_normative, marker, ordinal) of the texts that can be read.

    seq is the place in the text; ordinal the place among the children of the parent, null where the parent does not list the node. Texts are made and read once.
    """
    each = by_document(texts).select("doc_id", F.posexplode(F.from_json(F.get_json_object("json", "$.nodes"), f"array<struct<{_NODE}>>")).alias("seq", "n"))
    # Nodes and the places that their parents list meet within a document, which is in one task.
    own = F.struct(F.col("seq").cast("long").alias("seq"), "n.ptype", "n.local_id", "n.citation", "n.heading", "n.text", "n.is_normative", "n.marker")
    row = lambda parent, name, own, ordinal: F.struct(parent.alias("parent_id"), name.alias("node_id"), own.alias("own"), ordinal.alias("ordinal"))
    alone = F.array(row(F.col("n.parent"), F.col("n.id"), own, F.lit(None).cast("int")))
    listed = F.transform("n.children", lambda child, i: row(F.col("n.id"), child, _none(own), i))
    met = each.select("doc_id", F.inline(F.when(F.size("n.children") > 0, F.concat(alone, listed)).otherwise(alone))).where("own is not null or doc_id is not null and parent_id is not null and node_id is not null")
    met = met.groupBy("doc_id", "parent_id", "node_id").agg(F.collect_list("own").alias("own"), F.min("ordinal").alias("ordinal")).select("doc_id", "parent_id", "node_id", "ordinal", F.inline("own"))
    return met.select("doc_id", "node_id", "seq", "ptype", "local_id", "citation", "parent_id", "heading", "text", "is_normative", "marker", "ordinal")
