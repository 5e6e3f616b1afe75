"""Tables of sectors, subsectors and types of entities in annexes, from the places of words on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import by_document
from ..functions.text import dehyphenated

# Words of the running header, words of a page that may name its annex, the word that heads a table's second
# column, the part of a page left of its outer edge, how near vertical rules are one, where columns begin beside rules and markers.
HEADER_WORD = r"^(EN|\d{1,2}\.\d{1,2}\.\d{4}|L|\d+/\d+|Official|Journal|of|the|European|Union)$"
NAMING_WORDS = 40
COLUMN_HEAD = "Subsector"
INNER = 0.9
NEAR_RULES = 3
BEFORE_RULE, BEFORE_MARKER, SUBSECTOR_WIDTH = 1, 2, 90

_PAGE = ["doc_id", "page_no"]


def _pages(words: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, words, rules, width): a row for each page, words in their order. A document's pages meet in one task, so that nothing after this is sent again."""
    place = lambda rows, name, c, kind: rows.select(*_PAGE, *((c if n == name else F.lit(None)).cast(kind if n == name else t).alias(n) for n, t in kinds.items()))
    word = F.struct("seq", F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), "text")
    kinds = {"word": words.select(word.alias("w")).schema["w"].dataType, "rule": "double", "width": "double"}
    told = place(words, "word", word, kinds["word"]).union(place(rules, "rule", F.col("x0"), "double")).union(place(pages, "width", F.col("width"), "double"))
    return by_document(told).groupBy(*_PAGE).agg(F.sort_array(F.collect_list("word")).alias("words"), F.collect_list("rule").alias("rules"), F.max("width").alias("width"))


def _of_annexes(pages: DataFrame) -> DataFrame:
    """Pages that go on with a table, with annex; of an annex that begins more than once only the last counts."""
    line = F.array_join(F.transform(F.slice("words", 1, NAMING_WORDS), lambda w: w["text"]), " ")
    named = pages.where(F.size("words") > 0).withColumns({"named": F.regexp_extract(line, r"(?U)\bANNEX ([IVX]+)\b", 1), "headed": F.exists("words", lambda w: w["text"] == COLUMN_HEAD)})
    start = F.when(F.col("named") != "", F.struct(F.when(F.col("headed"), F.col("named")).alias("annex"), F.col("page_no").alias("first_page")))
    open_ = F.last(start, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page_no"))
    found = named.withColumn("a", open_).select(*pages.columns, "a.annex", "a.first_page").where("annex is not null")
    return found.withColumn("last", F.max("first_page").over(Window.partitionBy("doc_id", "annex"))).where("first_page = last and width is not null").drop("first_page", "last")


def _merged(rules: Column) -> Column:
    """Places of vertical rules from left to right; what lies near the last one kept is the same rule."""
    near = lambda kept, x: F.coalesce(x - F.try_element_at(kept, F.lit(-1)) <= NEAR_RULES, F.lit(False))
    fold = lambda kept, x: F.when(near(kept, x), kept).otherwise(F.array_append(kept, x))
    return F.aggregate(F.sort_array(rules), F.array().cast("array<double>"), fold)


def _column(condition: Column) -> Column:
    """The words of a line within a column, from left to right."""
    within = F.sort_array(F.collect_list(F.when(condition, F.struct("x0", "seq", "text"))))
    return F.trim(F.array_join(F.transform(within, lambda w: w["text"]), " "))


def table_lines(words: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, annex, page_no, y, sector, subsector, entity): lines of tables with their texts in three columns, without footnotes.

    words: doc_id, page_no, seq (place in the page), x0, top, bottom, text; rules: doc_id, page_no, x0 of vertical rules;
    pages: doc_id, page_no, width. Columns begin at the second and third rule of a page; with fewer rules, at its markers and
    dashes. Pages without either, words without a place or text, and pages without a width have no lines.
    """
    words = words.where("doc_id is not null and page_no is not null and x0 is not null and top is not null and text is not null")
    inner = F.col("width") * INNER
    body = _of_annexes(_pages(words, rules, pages)).withColumns({"words": F.filter("words", lambda w: ~((w["x0"] > inner) & w["text"].rlike(HEADER_WORD))), "rules": _merged(F.filter("rules", lambda x: x < inner))})
    start = F.get(F.filter("words", lambda w: w["text"] == COLUMN_HEAD), F.lit(0))["bottom"]
    # The start is an array's one item, else it would be looked for again at each word.
    body = body.withColumn("words", F.flatten(F.transform(F.array(F.coalesce(start, F.lit(0.0))), lambda y: F.filter("words", lambda w: w["top"] > y))))
    least = lambda test: F.array_min(F.transform(F.filter("words", test), lambda w: w["x0"]))
    body = body.withColumns({"letter": least(lambda w: w["text"].rlike(r"^\([a-z]\)$")), "dash": least(lambda w: w["text"] == "—")})
    ruled = F.size("rules") >= 3
    third = F.when(ruled, F.get("rules", F.lit(2)) - BEFORE_RULE).otherwise(F.col("dash") - BEFORE_MARKER)
    second = F.when(ruled, F.get("rules", F.lit(1)) - BEFORE_RULE).otherwise(F.coalesce(F.col("letter") - BEFORE_MARKER, F.col("third") - SUBSECTOR_WIDTH))
    body = body.withColumn("third", third).withColumn("second", second).where("third is not null").select("doc_id", "annex", "page_no", "second", "third", F.inline("words"))
    x = F.col("x0")
    columns = {"sector": (x >= 0) & (x < F.col("second")), "subsector": (x >= F.col("second")) & (x < F.col("third")), "entity": x >= F.col("third")}
    lines = body.groupBy("doc_id", "annex", "page_no", F.bround("top").alias("y")).agg(*(_column(c).alias(name) for name, c in columns.items()))
    note = F.max(F.col("sector").rlike(r"(?U)^\(\d+\)")).over(Window.partitionBy(*_PAGE).orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("note", note).where("not note").drop("note")


def entity_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, annex, kind, sector_at, sub_at, ent_at, number, name) of sectors, subsectors and entities in reading order.

    A number opens a sector, a letter a subsector, a dash an entity; other texts go on with what is open in their column.
    Entities of a sector that opens no subsector lie below the sector (sub_at counts such a group too, without a row).
    What stands before the first sector is left out.
    """
    run = Window.partitionBy("doc_id", "annex").orderBy("page_no", "y").rowsBetween(Window.unboundedPreceding, 0)
    in_sector = Window.partitionBy("doc_id", "annex", "sector_at").orderBy("page_no", "y").rowsBetween(Window.unboundedPreceding, 0)
    in_sub = Window.partitionBy("doc_id", "annex", "sector_at", "sub_at").orderBy("page_no", "y").rowsBetween(Window.unboundedPreceding, 0)
    opens_sector, opens_sub = F.col("sector").rlike(r"(?U)^\d+\.\s*"), F.col("subsector").rlike(r"^\([a-z]\)")
    told = F.col("entity") != ""
    rows = lines.withColumn("sector_at", F.count_if(opens_sector).over(run)).where("sector_at > 0")
    rows = rows.withColumn("lettered", F.count_if(opens_sub).over(in_sector))
    rows = rows.withColumn("plain", F.max(told & (F.col("lettered") == 0)).over(in_sector).cast("int")).withColumn("sub_at", F.col("lettered") + F.col("plain"))
    opens_entity = told & (F.startswith("entity", F.lit("—")) | (F.count_if(told).over(in_sub) == 1))
    rows = rows.withColumn("opens", opens_entity).withColumn("ent_at", F.count_if(F.col("opens")).over(in_sub))

    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    first = F.when(opens_sector, F.regexp_extract("sector", r"(?U)^(\d+)\.", 1))
    letter = F.when(opens_sub, F.regexp_extract("subsector", r"^\(([a-z])\)", 1))
    told_of = lambda kind, sub, ent, number, piece: F.struct(F.lit(kind).alias("kind"), "sector_at", sub.alias("sub_at"), ent.alias("ent_at"), number.alias("number"), piece.alias("piece"))
    pieces = F.array(
        told_of("sector", zero, zero, first, F.when(opens_sector, F.regexp_replace("sector", r"(?U)^\d+\.\s*", "")).otherwise(F.col("sector"))),
        told_of("subsector", F.col("sub_at"), zero, letter, F.when(opens_sub, F.regexp_replace("subsector", r"(?U)^\([a-z]\)\s*", "")).otherwise(F.col("subsector"))),
        told_of("entity_type", F.col("sub_at"), F.col("ent_at"), none, F.when(F.col("opens"), F.trim(F.regexp_replace("entity", "^[— ]+", ""))).otherwise(F.col("entity"))),
    )
    # What a line tells in its three columns is put together at once.
    each = rows.select("doc_id", "annex", "page_no", "y", F.inline(pieces)).where("kind = 'sector' or kind = 'subsector' and sub_at > 0 or kind = 'entity_type' and ent_at > 0")
    name = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("piece") != "", F.struct("page_no", "y", "piece")))), lambda p: p["piece"]), " ")
    out = each.groupBy("doc_id", "annex", "kind", "sector_at", "sub_at", "ent_at").agg(F.max("number").alias("number"), name.alias("name"))
    return out.where("kind <> 'subsector' or number is not null").withColumn("number", F.when(F.col("kind") == "entity_type", F.col("ent_at").cast("string")).otherwise(F.col("number")))


def entity_nodes(rows: DataFrame, annexes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ptype, local_id, citation, parent_id, heading, text, place) of rows of entity_rows.

    annexes: doc_id, annex, node_id, citation of the acts' annexes; tables of other annexes are left out. An id met again
    gets `~2`, `~3` and so on, and what lies below it too. Headings and texts are without soft hyphens. place orders the
    nodes of an annex.
    """
    key, kind, number = ["doc_id", "annex"], F.col("kind"), F.col("number")
    named = annexes.groupBy("doc_id").agg(F.collect_list(F.struct("annex", "node_id", "citation")).alias("annexes"))
    rows = rows.join(named, "doc_id").withColumn("a", F.get(F.filter("annexes", lambda a: a["annex"] == F.col("annex")), F.lit(0))).where("a is not null").drop("annexes")
    # Nodes above a row are found by windows over its annex, which is in one task anyway.
    nth = F.row_number().over(Window.partitionBy(*key, "kind", F.when(kind == "subsector", F.col("sector_at")), "number").orderBy("sector_at", "sub_at"))
    rows = rows.withColumn("nth", F.when(kind != "entity_type", nth))
    step = F.concat(F.when(kind == "sector", ".sec_").otherwise(".sub_"), "number", F.when(F.col("nth") > 1, F.concat(F.lit("~"), "nth")).otherwise(""))
    of = lambda name: F.max(F.when(kind == name, F.struct(step.alias("step"), "number")))
    rows = rows.withColumn("sub", of("subsector").over(Window.partitionBy(*key, "sector_at", "sub_at"))).withColumn("sec", of("sector").over(Window.partitionBy(*key, "sector_at")))
    rows = rows.withColumns({"sector_id": F.concat("a.node_id", "sec.step"), "sector_cite": F.concat("a.citation", F.lit(", point "), "sec.number")})
    rows = rows.withColumns({"sub_id": F.concat("sector_id", "sub.step"), "sub_cite": F.concat("sector_cite", F.lit("("), "sub.number", F.lit(")"))})
    parent, cite = F.coalesce("sub_id", "sector_id"), F.coalesce("sub_cite", "sector_cite")
    by_kind = lambda first, second, third: F.when(kind == "sector", first).when(kind == "subsector", second).otherwise(third)
    text, empty, low = dehyphenated(F.col("name")), F.lit(""), kind == "entity_type"
    return rows.select(
        "doc_id", by_kind(F.col("sector_id"), F.col("sub_id"), F.concat(parent, F.lit(".ent_"), number)).alias("node_id"), kind.alias("ptype"), number.alias("local_id"),
        by_kind(F.col("sector_cite"), F.col("sub_cite"), F.concat(cite, F.lit(", entity "), number)).alias("citation"), by_kind(F.col("a.node_id"), F.col("sector_id"), parent).alias("parent_id"),
        F.when(low, empty).otherwise(text).alias("heading"), F.when(low, text).otherwise(empty).alias("text"), F.struct("annex", "sector_at", "sub_at", "ent_at").alias("place"),
    )


def annexes_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, annex, node_id, citation): the annexes that tables may belong to, of acts of which one annex at least is a table."""
    acts = nodes.where("ptype = 'table_annex'").select("doc_id").distinct()
    annex = F.regexp_extract("node_id", r"^[^:]*:anx_([IVX]+)$", 1)
    return nodes.join(acts, "doc_id", "left_semi").select("doc_id", annex.alias("annex"), "node_id", "citation").where("annex <> ''")


def nodes(words: DataFrame, rules: DataFrame, pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """The nodes of entity_nodes of all tables of acts, parsed being their nodes so far."""
    return entity_nodes(entity_rows(table_lines(words, rules, pages)), annexes_of(parsed))
