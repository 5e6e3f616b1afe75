"""Acts in Formex XML as a node table.

A small reader turns each file into rows of elements with their ancestors; numbers, texts, paths and order come from
joins and aggregates over those rows, so a file is no unit of work but where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.text import item_marker, number

# Elements of an act whose text is not their parent's; elements that tell a number.
STRUCTURE = "ACT ARTICLE ANNEX CHAPTER ITEM LIST PARAG PART RECITAL SECTION SUBPARAG".split()
MARKERS = "NO.ANNEX NO.ART NO.CHAPTER NO.PARAG NO.POINT NO.SECTION".split()
#: Of each kind of node the elements that tell its number.
NUMBERED = {"RECITAL": ["NO.RECITAL", "NO.RCT"], "ARTICLE": ["NO.ART"], "PARAG": ["NO.PARAG"], "ITEM": ["NO.POINT", "NO.ITEM"], "ANNEX": ["NO.ANNEX"], "CHAPTER": ["NO.CHAPTER"], "SECTION": ["NO.SECTION"], "PART": ["NO.PART"]}
GROUPS = {"CHAPTER": ("chapter", "chap", "Chapter"), "SECTION": ("section", "sec", "Section"), "PART": ("part", "part", "Part")}
ANNEX_TITLES = ["TI.ANNEX", "TITLE"]

_ELEMENT = "doc_id string, seq int, tag string, identifier string, text string, text_at int, tail string, tail_at int, up array<struct<seq:int,tag:string>>, error string"
_UP = pa.list_(pa.struct([("seq", pa.int32()), ("tag", pa.string())]))


def _read(doc_id: str, source: bytes | None) -> list[tuple]:
    """Elements in document order; or one row with an error for what is not well formed or declares a document type."""
    if re.search(rb"<!DOCTYPE|<!ENTITY", source or b"", re.IGNORECASE):
        return [(doc_id, None, None, None, None, None, None, None, None, "document types are not read")]
    try:
        root = ElementTree.fromstring(source or b"")
    except ElementTree.ParseError as e:
        return [(doc_id, None, None, None, None, None, None, None, None, f"not well formed: {e}")]
    out, at = [], 0
    pending: list[tuple] = [(root, [], None)]
    while pending:
        element, up, row = pending.pop()
        at += 1
        if row is not None:  # the element has ended
            row[6], row[7] = element.tail, at
            continue
        tag = element.tag.rpartition("}")[2].upper()
        row = [doc_id, len(out), tag, element.get("IDENTIFIER"), element.text, at, None, None, up, None]
        out.append(row)
        pending.append((element, up, row))
        own = [*up, {"seq": row[1], "tag": tag}]
        pending += [(child, own, None) for child in reversed(element)]
    return list(map(tuple, out))


def elements(files: DataFrame) -> DataFrame:
    """The elements of files (doc_id, content binary or text), written once, since many joins read them. doc_id is unique. Places of texts (text_at, tail_at) order all texts of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.string(), pa.int32(), _UP, pa.string()]
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                rows = _read(doc, content)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "seq", "tag", "identifier", "text", "text_at", "tail", "tail_at", "up", "error"])

    return checkpointed(files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, _ELEMENT))


def _joined_text(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `told`: the pieces (keys, at, piece) of each in order, with single spaces."""
    every = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("all"))
    return every.select(*keys, F.trim(F.regexp_replace(F.array_join(F.transform("all", lambda x: x["piece"]), " "), r"(?U)\s+", " ")).alias("told"))


def _last(up, tags: list[str]):
    """The nearest of the ancestors with one of the tags."""
    return F.try_element_at(F.filter(up, lambda a: a["tag"].isin(tags)), F.lit(-1))


def act_nodes(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, seq, ptype, local_id, citation, parent_id, heading, text, is_normative, marker, copies) of files (doc_id, short_name, content).

    Files whose root is no ACT, or that cannot be read, have no nodes. Where an id repeats, its first place and the text
    and heading of its last one count, and `copies` says how often it was met (groups of articles once). Lists count where
    they are children of a paragraph, item or annex. A number that no element tells is the node's place.
    """
    found = found if found is not None else elements(files)
    acts = found.where("seq = 0 and tag = 'ACT'").select("doc_id").distinct()
    e = found.where("error is null").join(acts, "doc_id", "left_semi").withColumn("path", F.array_append("up", F.struct("seq", "tag")))
    parent = F.try_element_at("up", F.lit(-1))
    grand = F.try_element_at("up", F.lit(-2))

    # Texts by the nearest element that keeps its text to itself.
    own = e.select("doc_id", F.col("text_at").alias("at"), F.col("text").alias("piece"), F.col("path").alias("of"))
    after = e.where(F.size("up") > 0).select("doc_id", F.col("tail_at"), "tail", "up")
    pieces = own.union(after).where("piece is not null and piece <> ''")
    texts = _joined_text(pieces.withColumn("seq", _last("of", STRUCTURE + MARKERS)["seq"]).select("doc_id", "seq", "at", "piece"), ["doc_id", "seq"])

    # Whole texts of the elements that tell numbers and titles.
    names = sorted({t for tags in NUMBERED.values() for t in tags} | {"TI", *ANNEX_TITLES})
    told = _joined_text(pieces.select("doc_id", "at", "piece", F.explode(F.filter("of", lambda a: a["tag"].isin(names))).alias("m")).select("doc_id", F.col("m.seq").alias("seq"), "at", "piece"), ["doc_id", "seq"]).where("told <> ''")
    telling = e.where(F.col("tag").isin(names)).join(told, ["doc_id", "seq"]).select("doc_id", F.col("seq").alias("m"), F.col("tag").alias("name"), "told", F.explode("up").alias("a"), parent["seq"].alias("above"))
    named = F.lit(False)
    for tag, tags in NUMBERED.items():
        named = named | (F.col("a.tag") == tag) & F.col("name").isin(tags)
    numbers = telling.where(named).groupBy("doc_id", F.col("a.seq").alias("seq")).agg(F.min_by("told", "m").alias("number_text"))
    every_title = e.where("tag = 'TI'").join(told, ["doc_id", "seq"], "left").select("doc_id", F.col("seq").alias("m"), F.coalesce("told", F.lit("")).alias("told"), F.explode("up").alias("a"))
    titles = every_title.groupBy("doc_id", F.col("a.seq").alias("seq")).agg(F.min_by("told", "m").alias("title"))
    annex_titles = telling.where(F.col("name").isin(ANNEX_TITLES) & (F.col("a.seq") == F.col("above"))).groupBy("doc_id", F.col("above").alias("seq")).agg(F.min_by("told", "m").alias("annex_title"))

    kept = e.where(F.col("tag").isin(list(NUMBERED))).select("doc_id", "seq", "tag", "identifier", "up", "path", parent["tag"].alias("in_tag"), parent["seq"].alias("in_seq"), grand["tag"].alias("grand_tag"))
    place = F.row_number().over(Window.partitionBy("doc_id", "in_seq", "tag").orderBy("seq"))
    order = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy("seq"))
    kept = kept.withColumns({"place": place, "order": order}).join(numbers, ["doc_id", "seq"], "left").join(titles, ["doc_id", "seq"], "left").join(annex_titles, ["doc_id", "seq"], "left").join(texts, ["doc_id", "seq"], "left")
    fallback = F.when(F.col("tag") == "RECITAL", F.col("seq") + 1).when(F.col("tag") == "ANNEX", F.col("order")).when(F.col("tag") == "ARTICLE", F.col("seq") + 1).otherwise(F.col("place"))
    n = number(F.coalesce("number_text", "identifier"), fallback)
    kept = kept.withColumn("n", F.when(F.col("tag").isin("ARTICLE", "PARAG"), F.substring_index(n, ".", 1)).otherwise(n))

    # Items and paragraphs count where every element between them and their article or annex is one of their kind.
    child = (F.col("tag") == "ITEM") & (F.col("in_tag") == "LIST") & F.col("grand_tag").isin("PARAG", "ITEM", "ANNEX") | (F.col("tag") == "PARAG") & (F.col("in_tag") == "ARTICLE")
    grouped = e.where("tag = 'ARTICLE'").select("doc_id", F.col("seq").alias("article"), F.explode(F.filter("up", lambda a: a["tag"].isin(list(GROUPS)))).alias("g")).groupBy("doc_id", F.col("g.seq").alias("seq")).agg(F.min("article").alias("first_article"))
    kept = kept.join(grouped, ["doc_id", "seq"], "left").where(F.col("tag").isin("RECITAL", "ARTICLE", "ANNEX") | child | F.col("first_article").isNotNull())

    # The chain of kept elements from the outermost on gives ids and citations.
    chain = kept.select("doc_id", "seq", F.posexplode("path").alias("level", "a"))
    known = kept.select("doc_id", F.col("seq").alias("a_seq"), F.col("tag").alias("a_tag"), F.col("n").alias("a_n"))
    links = chain.select("doc_id", "seq", "level", F.col("a.seq").alias("a_seq")).join(known, ["doc_id", "a_seq"])
    chained = links.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("level", "a_tag", "a_n"))).alias("chain"))
    short = files.select(F.col("doc_id").cast("string").alias("doc_id"), "short_name")
    rows = kept.join(chained, ["doc_id", "seq"]).join(short, "doc_id")
    outer = F.filter("chain", lambda a: a["a_tag"].isin(list(GROUPS)))
    inner = F.filter("chain", lambda a: ~a["a_tag"].isin(list(GROUPS)))
    step = lambda a: F.concat(F.when(a["a_tag"] == "RECITAL", "rec_").when(a["a_tag"] == "ARTICLE", "art_").when(a["a_tag"] == "ANNEX", "anx_").when(a["a_tag"] == "PARAG", "par_").when(a["a_tag"] == "ITEM", "point_").when(a["a_tag"] == "CHAPTER", "chap_").when(a["a_tag"] == "SECTION", "sec_").otherwise("part_"), F.when(a["a_tag"] == "ITEM", F.replace(a["a_n"], F.lit("."), F.lit("_"))).otherwise(a["a_n"]))
    label = lambda a: F.concat(F.lit(" "), F.when(a["a_tag"] == "RECITAL", F.concat(F.lit("Recital ("), a["a_n"], F.lit(")"))).when(a["a_tag"] == "ARTICLE", F.concat(F.lit("Art. "), a["a_n"])).when(a["a_tag"] == "ANNEX", F.concat(F.lit("Annex "), a["a_n"])).otherwise(F.concat(F.initcap(a["a_tag"]), F.lit(" "), a["a_n"])))
    cited = lambda c: F.array_join(F.transform(c, lambda a: F.when(a["a_tag"].isin("PARAG", "ITEM"), F.concat(F.lit("("), a["a_n"], F.lit(")"))).otherwise(label(a))), "")
    is_group = F.col("tag").isin(list(GROUPS))
    own_chain = F.when(is_group, outer).otherwise(inner)
    above = F.slice(own_chain, F.lit(1), F.size(own_chain) - 1)
    root = F.concat(F.lower("short_name"), F.lit(":"))
    path = lambda c: F.concat(root, F.array_join(F.transform(c, step), "."))
    top = F.when(is_group | ~F.col("tag").isin("ARTICLE") | (F.size(outer) == 0), F.concat(root, F.lit("preamble"))).otherwise(path(outer))
    ptype = F.when(F.col("tag") == "PARAG", "paragraph").when(F.col("tag") == "ITEM", "point").otherwise(F.lower("tag"))
    section = F.when(F.col("tag") == "RECITAL", 1).when(F.array_contains(F.transform("chain", lambda a: a["a_tag"]), "ANNEX"), 3).otherwise(2)
    marker = F.when(F.col("tag") == "PARAG", "paragraph").when(F.col("tag") == "ITEM", item_marker(F.col("n"))).otherwise("")
    heading = F.when(F.col("tag") == "ANNEX", F.col("annex_title")).when(is_group | (F.col("tag") == "ARTICLE"), F.col("title"))
    body = F.when(~is_group, F.col("told"))
    paragraphs = kept.where("tag = 'PARAG'").select("doc_id", F.col("in_seq").alias("seq"), F.lit(True).alias("divided")).distinct()
    rows = rows.join(paragraphs, ["doc_id", "seq"], "left")
    body = F.when((F.col("tag") == "ARTICLE") & F.col("divided"), F.lit("")).otherwise(body)
    rows = rows.select(
        "doc_id", path(own_chain).alias("node_id"), F.struct(section.alias("a"), F.coalesce("first_article", "seq").alias("b"), F.when(is_group, F.size(outer)).otherwise(100).alias("c"), F.col("seq").alias("d")).alias("at"),
        ptype.alias("ptype"), F.col("n").alias("local_id"), F.concat("short_name", cited(own_chain)).alias("citation"), F.when(F.size(above) > 0, path(above)).otherwise(top).alias("parent_id"),
        F.coalesce(heading, F.lit("")).alias("heading"), F.coalesce(body, F.lit("")).alias("text"), (F.col("tag") != "RECITAL").alias("is_normative"), marker.alias("marker"), is_group.alias("group"),
    )
    first = rows.groupBy("doc_id", "node_id").agg(F.min_by(F.struct("ptype", "local_id", "citation", "parent_id", "is_normative", "marker", "at", F.col("heading").alias("first_heading")), "at").alias("f"), F.max_by(F.struct("heading", "text"), "at").alias("l"), F.count_if(~F.col("group")).alias("copies"))
    nothing = F.lit("")
    pre = short.join(acts, "doc_id", "left_semi").select("doc_id", F.concat(F.lower("short_name"), F.lit(":preamble")).alias("node_id"), F.lit("preamble").alias("ptype"), F.lit("pre").alias("local_id"), F.concat("short_name", F.lit(" Preamble")).alias("citation"), F.lit(None).cast("string").alias("parent_id"), nothing.alias("heading"), nothing.alias("text"), F.lit(False).alias("is_normative"), nothing.alias("marker"), F.lit(1).cast("long").alias("copies"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("at"))
    rest = first.select("doc_id", "node_id", "f.ptype", "f.local_id", "f.citation", "f.parent_id", F.when(F.col("copies") == 0, F.col("f.first_heading")).otherwise(F.col("l.heading")).alias("heading"), "l.text", "f.is_normative", "f.marker", F.greatest("copies", F.lit(1)).alias("copies"), "f.at")
    whole = pre.unionByName(rest)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return whole.withColumn("seq", seq).select("doc_id", "node_id", "seq", "ptype", "local_id", "citation", "parent_id", "heading", "text", "is_normative", "marker", "copies")


def parse_findings(files: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, message): files that cannot be read, roots other than ACT, ids met more than once."""
    broken = found.where("error is not null").select("doc_id", F.col("error").alias("message"))
    other = found.where("seq = 0 and tag <> 'ACT'").select("doc_id", F.lit("the root is no ACT").alias("message"))
    repeated = nodes.where("copies > 1").select("doc_id", F.concat(F.lit("Duplicate identifier "), "node_id", F.lit(" ("), "citation", F.lit(")")).alias("message"))
    return reduce(DataFrame.union, [broken, other, repeated])
