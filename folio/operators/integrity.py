"""Checks of a parsed act: repeated ids, gaps and breaks of numbering, what the source declares of itself.

A node table has doc_id, node_id, seq, ptype, local_id, citation, parent_id, heading, marker, ordinal (among its siblings, from 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import tabled
from ..functions.text import normal_title, roman_value

#: Types of nodes that count as annexes; types of documents whose full text needs a licence.
ANNEXES = ["annex", "amending_annex", "table_annex", "correlation_annex"]
LICENSED = ["InternationalStandard", "EuropeanStandard", "TechnicalSpecification", "TechnicalReport"]
#: Gaps of recitals that a report lists.
RECITAL_GAPS = 10


def duplicate_ids(children: DataFrame, parent: str, number: str) -> DataFrame:
    """(parent, number, copies) of numbers that a parent has more than once."""
    return children.groupBy(parent, number).agg(F.count("*").alias("copies")).where("copies > 1")


def numbering_gaps(children: DataFrame, parent: str, number: str) -> DataFrame:
    """(parent, after, before, missing): neighbours in the order of numbers that are more than one apart; 0 stands before the first."""
    known = children.select(parent, F.col(number).cast("int").alias("before")).distinct()
    previous = F.coalesce(F.lag("before").over(Window.partitionBy(parent).orderBy("before")), F.lit(0))
    gaps = known.withColumn("after", previous).where("before - after > 1")
    return gaps.select(parent, "after", "before", (F.col("before") - F.col("after") - 1).alias("missing"))


def renamed(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """nodes with `node_id` made unique: the k-th row of an id in the given order gets ~k from 2 on. `copy` is k."""
    copy = F.row_number().over(Window.partitionBy(*keys, "node_id").orderBy(*order))
    named = nodes.withColumn("copy", copy)
    return named.withColumn("node_id", F.when(F.col("copy") > 1, F.concat("node_id", F.lit("~"), "copy")).otherwise(F.col("node_id")))


def _runs(seen: Column) -> Column:
    """The numbers from 1 that a set lacks below its highest one, as runs (first, last): no more of them than numbers found."""
    found = F.array_sort(F.filter(seen, lambda n: n >= 1))
    between = F.zip_with(F.slice(F.concat(F.array(F.lit(0)), found), F.lit(1), F.size(found)), found, lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    lone = F.array(F.struct(F.lit(1).alias("first"), F.lit(1).alias("last")))
    return F.when(F.array_max(seen) < 1, lone).otherwise(F.filter(between, lambda r: r["first"] <= r["last"]))


def kind_gaps(nodes: DataFrame, runs: bool = False) -> DataFrame:
    """(doc_id, kind, n_found, gaps): articles by the digits they start with, annexes by Roman numerals, recitals; gaps up to the highest number, of recitals the first ten.

    Numbers that cannot be read count as found and fill no gap. With `runs`, all gaps are told as runs (first, last), whose number does not depend on how high the numbers are.
    """
    n = F.when(F.col("kind") == "annex", roman_value(F.col("local_id"))).otherwise(F.regexp_extract("local_id", r"^\d+", 0).try_cast("int"))
    kind = F.when(F.col("ptype").isin(ANNEXES), "annex").when(F.col("ptype").isin("article", "recital"), F.col("ptype"))
    found = nodes.select("doc_id", kind.alias("kind"), "local_id").where("kind is not null").select("doc_id", "kind", n.alias("n"))
    sets = found.groupBy("doc_id", "kind").agg(F.count("*").alias("n_found"), F.collect_set("n").alias("seen"))
    if runs:
        return sets.select("doc_id", "kind", "n_found", _runs(F.col("seen")).alias("gaps"))
    gaps = F.when(F.size("seen") == 0, F.array().cast("array<int>")).otherwise(F.array_except(F.sequence(F.lit(1), F.greatest(F.array_max("seen"), F.lit(1))), "seen"))
    return sets.select("doc_id", "kind", "n_found", F.when(F.col("kind") == "recital", F.slice(gaps, 1, RECITAL_GAPS)).otherwise(gaps).alias("gaps"))


def without_articles(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, message) of documents without any article."""
    missing = documents.select("doc_id").distinct().join(nodes.where("ptype = 'article'"), "doc_id", "left_anti")
    return missing.withColumn("message", F.lit("No articles found"))


def letter_breaks(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, found): parents whose lettered children are not a, b, c and on, in order."""
    lettered = nodes.where("marker = 'letter' and parent_id is not null").groupBy("doc_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "local_id"))), lambda x: x["local_id"]).alias("found"))
    wanted = F.transform(F.sequence(F.lit(0), F.size("found") - 1), lambda i: F.char(F.lit(97) + i))
    return lettered.where(F.col("found") != wanted)


def paragraph_breaks(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, found): parents whose numbered paragraphs do not run from 1, or in a part from where the parts before it ended."""
    numbered = nodes.where((F.col("ptype") == "paragraph") & F.col("local_id").rlike(r"^\d+$") & F.col("parent_id").isNotNull()).select("doc_id", "parent_id", "ordinal", F.col("local_id").cast("int").alias("n"))
    lists = numbered.groupBy("doc_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "n"))), lambda x: x["n"]).alias("found"), F.max("n").alias("top"))
    own = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("above"), "ptype", "ordinal")
    siblings = Window.partitionBy("doc_id", "above", "ptype").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    part = (F.col("ptype") == "part") & F.col("above").isNotNull()
    before = own.join(lists, ["doc_id", "parent_id"]).withColumn("before", F.when(part, F.max("top").over(siblings)))
    start = F.when(F.col("found")[0] == F.col("before") + 1, F.col("found")[0]).otherwise(1)
    wanted = F.sequence(start, start + F.size("found") - 1)
    return before.where(F.col("found") != wanted).select("doc_id", "parent_id", "found")


def section_breaks(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, found): parents whose sections are not 1, 2, 3 and on."""
    lists = nodes.where("ptype = 'section' and parent_id is not null").groupBy("doc_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "local_id"))), lambda x: x["local_id"]).alias("found"))
    return lists.where(F.col("found") != F.transform(F.sequence(F.lit(1), F.size("found")), lambda i: i.cast("string")))


def headingless_articles(nodes: DataFrame) -> DataFrame:
    """(doc_id, citation) of articles without a heading."""
    return nodes.where("ptype = 'article' and coalesce(heading, '') = ''").select("doc_id", "citation")


def node_type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "ptype").agg(F.count("*").alias("n"))


def unrecorded_amendments(titles: DataFrame, amendments: DataFrame) -> DataFrame:
    """(doc_id, act) of acts that a title amends (doc_id, act) and that no amendment (doc_id, target_act) is recorded for."""
    return titles.select("doc_id", "act").distinct().join(amendments.select("doc_id", F.col("target_act").alias("act")), ["doc_id", "act"], "left_anti")


def declaration_errors(documents: DataFrame) -> DataFrame:
    """(doc_id, message) where the address or the title that is declared differs from what the source says.

    documents: doc_id, eli_uri, canonical, title, detected_title. A title must be part of the detected one, unless that is a file's name.
    """
    stripped = lambda c: F.regexp_replace(c, "/+$", "")
    address = (F.coalesce("eli_uri", F.lit("")) != "") & (F.coalesce("canonical", F.lit("")) != "") & (stripped(F.col("eli_uri")) != stripped(F.col("canonical")))
    detected = F.coalesce("detected_title", F.lit(""))
    titled = (detected != "") & ~detected.rlike(r"^L_\d{9}[A-Z]{2}\.\d+\.fmx\.xml$") & ~F.contains(normal_title(detected), normal_title(F.col("title")))
    found = F.array_compact(F.array(F.when(address, F.lit("canonical address differs from the declared one")), F.when(titled, F.lit("source title differs from the declared one"))))
    return documents.select("doc_id", F.explode(found).alias("message"))


def gate(documents: DataFrame, findings: DataFrame, override: bool = False) -> DataFrame:
    """Documents that may be extracted from: those without findings (doc_id), or all."""
    return documents if override else documents.join(findings.select("doc_id").distinct(), "doc_id", "left_anti")


def storable(documents: DataFrame, licensed: bool = False) -> DataFrame:
    """documents with `store_text`: full texts of licensed types are stored only where that is allowed."""
    return documents.withColumn("store_text", F.lit(licensed) | ~F.col("doc_type").isin(LICENSED))


def report(nodes: DataFrame, errors: DataFrame, runs: bool = False) -> DataFrame:
    """One row a document: doc_id, errors, articles_found, article_gaps, annexes_found, annex_gaps, recitals_found, recital_gaps, sequence_errors, articles_without_heading.

    errors: doc_id, place, message of what the parser found, in order; `No articles found` comes after them. Breaks are told in the order of their parents, of
    one parent letters before paragraphs before sections. A document of which there are only errors has empty lists besides. Each list is one document's.
    What makes the nodes runs once, though each list reads them. With `runs`, gaps are told as in kind_gaps.
    """
    nodes = tabled(nodes.select("doc_id", "node_id", "seq", "ptype", "local_id", "citation", "parent_id", "heading", "marker", "ordinal"))
    documents = nodes.select("doc_id").union(errors.select("doc_id")).distinct()
    told = errors.select("doc_id", F.struct(F.lit(0).alias("late"), F.col("place").cast("long").alias("place"), "message").alias("e"))
    told = told.union(documents.join(nodes.where("ptype = 'article'"), "doc_id", "left_anti").select("doc_id", F.struct(F.lit(1).alias("late"), F.lit(0).cast("long").alias("place"), F.lit("No articles found").alias("message"))))
    listed = lambda rows, name, item: rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x[item]).alias(name))
    kinds = kind_gaps(nodes, runs).groupBy("doc_id").agg(*(F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name) for kind, many, one in (("article", "articles", "article"), ("annex", "annexes", "annex"), ("recital", "recitals", "recital")) for c, name in (("n_found", f"{many}_found"), ("gaps", f"{one}_gaps"))))
    words = F.concat(F.lit("letters ("), F.array_join("found", ")("), F.lit(")"))
    numbers = lambda name: F.concat(F.lit(f"{name} ["), F.array_join(F.col("found").cast("array<string>"), ", "), F.lit("]"))
    breaks = [(0, letter_breaks(nodes), words), (1, paragraph_breaks(nodes), numbers("paragraphs")), (2, section_breaks(nodes), numbers("sections"))]
    broken = [rows.select("doc_id", F.col("parent_id").alias("node_id"), F.lit(rank).alias("rank"), said.alias("said")) for rank, rows, said in breaks]
    broken = broken[0].union(broken[1]).union(broken[2]).join(nodes.select("doc_id", "node_id", "seq", "citation"), ["doc_id", "node_id"])
    sequence = broken.select("doc_id", F.struct("seq", "node_id", "rank", F.concat("citation", F.lit(": "), "said").alias("message")).alias("e"))
    bare = nodes.where("ptype = 'article' and coalesce(heading, '') = ''").select("doc_id", F.struct("seq", "node_id", "citation").alias("e"))
    found = documents.join(listed(told, "errors", "message"), "doc_id", "left").join(kinds, "doc_id", "left").join(listed(sequence, "sequence_errors", "message"), "doc_id", "left").join(listed(bare, "articles_without_heading", "citation"), "doc_id", "left")
    none, counts = F.array(), ["articles_found", "annexes_found", "recitals_found"]
    gaps, lists = ["article_gaps", "annex_gaps", "recital_gaps"], ["errors", "sequence_errors", "articles_without_heading"]
    return found.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), *(F.coalesce(c, none.cast("array<struct<first:int,last:int>>" if runs else "array<int>")).alias(c) for c in gaps), *(F.coalesce(c, none.cast("array<string>")).alias(c) for c in lists))
