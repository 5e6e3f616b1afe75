"""Queries over a synthetic act and over small texts, and the same in DuckDB's SQL.

The act: regions are documents, nations chapters, customers articles, orders paragraphs, lines of orders lettered points. SQL for the
small texts states the rows that the rules give, worked out by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lineage import tabled
from ..operators import conditions, integrity, ontology, packages, reconcile, signals, units
from ..sources import act_html, formex, layout
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def synthetic_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, node_id, seq, ptype, local_id, citation, parent_id, heading, text, is_normative, marker, ordinal, copy. Ids of points that repeat are renamed."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    doc = F.concat(F.lit("r"), F.col("n_regionkey"))
    chapter = F.concat(doc, F.lit(":chap_"), F.col("n_nationkey"))
    own = nations.select(doc.alias("doc_id"), chapter.alias("chapter"), F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("heading"))
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    paragraphs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", order.alias("par"), "o_orderpriority")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    modal = F.when(F.col("l_returnflag") == "A", "shall").when(F.col("l_returnflag") == "N", "may").otherwise("must")
    sentence = F.concat(F.lit("The supplier "), modal, F.lit(" deliver "), F.col("l_quantity").cast("int"), F.lit(" units within "), F.col("l_linenumber"), F.lit(" days"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.char(96 + F.col("l_linenumber")).alias("letter"), sentence.alias("text"), F.row_number().over(line).alias("at"), F.row_number().over(same).alias("copy"))

    articles = customers.select("c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")).join(F.broadcast(own), "c_nationkey")  # one row for each nation
    art = F.concat("doc_id", F.lit(":art_"), "c_custkey")
    cite = F.concat("doc_id", F.lit(" Art. "), "c_custkey")
    base = F.col("c_custkey").cast("long") * 1_000_000
    below = articles.drop("segment", "heading").join(paragraphs, "c_custkey")
    par, par_cite = F.concat(art, F.lit(".par_"), "par"), F.concat(cite, F.lit("("), "par", F.lit(")"))
    points = below.join(lines, "o_orderkey")
    point = F.concat(par, F.lit(".let_"), "letter", F.when(F.col("copy") > 1, F.concat(F.lit("~"), "copy")).otherwise(""))

    def rows(df: DataFrame, node, seq, ptype: str, local, citation, parent, heading, body, marker: str, ordinal, copy) -> DataFrame:
        return df.select("doc_id", node.alias("node_id"), seq.cast("long").alias("seq"), F.lit(ptype).alias("ptype"), local.cast("string").alias("local_id"), citation.alias("citation"), parent.alias("parent_id"), heading.alias("heading"), body.alias("text"), F.lit(True).alias("is_normative"), F.lit(marker).alias("marker"), ordinal.cast("int").alias("ordinal"), copy.cast("int").alias("copy"))

    one, zero = F.lit(1), F.lit(0)
    chapters = rows(own, F.col("chapter"), F.col("c_nationkey") - 1000, "chapter", F.col("c_nationkey"), F.concat("doc_id", F.lit(" Chapter "), "c_nationkey"), none, F.col("heading"), F.lit(""), "", F.col("c_nationkey"), one)
    middle = rows(articles, art, base, "article", F.col("c_custkey"), cite, F.col("chapter"), F.col("segment"), F.lit(""), "", zero, one)
    inner = rows(below, par, base + F.col("par") * 1000, "paragraph", F.col("par"), par_cite, art, F.lit(""), F.col("o_orderpriority"), "paragraph", F.col("par") - 1, one)
    last = rows(points, point, base + F.col("par") * 1000 + F.col("at"), "point", F.col("letter"), F.concat(par_cite, F.lit("("), "letter", F.lit(")")), par, F.lit(""), F.col("text"), "letter", F.col("at") - 1, F.col("copy"))
    return chapters.union(middle).union(inner).union(last)


_ACT = """act AS (
    WITH own AS (SELECT 'r' || n_regionkey AS doc_id, 'r' || n_regionkey || ':chap_' || n_nationkey AS chapter, n_nationkey, n_name FROM nation),
    p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS par, o_orderpriority FROM orders),
    l AS (SELECT l_orderkey, chr(96 + CAST(l_linenumber AS INTEGER)) AS letter, 'The supplier ' || CASE l_returnflag WHEN 'A' THEN 'shall' WHEN 'N' THEN 'may' ELSE 'must' END
        || ' deliver ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' units within ' || CAST(l_linenumber AS VARCHAR) || ' days' AS text,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS copy FROM lineitem),
    a AS (SELECT doc_id, chapter, c_custkey, doc_id || ':art_' || c_custkey AS art, doc_id || ' Art. ' || c_custkey AS cite, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer JOIN own ON c_nationkey = n_nationkey),
    b AS (SELECT a.*, o_orderkey, par, o_orderpriority, art || '.par_' || par AS pid, cite || '(' || par || ')' AS pcite FROM a JOIN p ON c_custkey = o_custkey)
    SELECT doc_id, chapter AS node_id, CAST(n_nationkey - 1000 AS BIGINT) AS seq, 'chapter' AS ptype, CAST(n_nationkey AS VARCHAR) AS local_id, doc_id || ' Chapter ' || n_nationkey AS citation, CAST(NULL AS VARCHAR) AS parent_id, n_name AS heading, '' AS text, '' AS marker, CAST(n_nationkey AS INTEGER) AS ordinal, 1 AS copy FROM own
    UNION ALL SELECT doc_id, art, CAST(c_custkey AS BIGINT) * 1000000, 'article', CAST(c_custkey AS VARCHAR), cite, chapter, segment, '', '', 0, 1 FROM a
    UNION ALL SELECT doc_id, pid, CAST(c_custkey AS BIGINT) * 1000000 + par * 1000, 'paragraph', CAST(par AS VARCHAR), pcite, art, '', o_orderpriority, 'paragraph', CAST(par - 1 AS INTEGER), 1 FROM b
    UNION ALL SELECT doc_id, pid || '.let_' || letter || CASE WHEN copy > 1 THEN '~' || copy ELSE '' END, CAST(c_custkey AS BIGINT) * 1000000 + par * 1000 + pos, 'point', letter, pcite || '(' || letter || ')', pid, '', text, 'letter', CAST(pos - 1 AS INTEGER), CAST(copy AS INTEGER) FROM b JOIN l ON o_orderkey = l_orderkey)"""


def act_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_act(spark, sf_dir).drop("is_normative")


def node_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.node_type_histogram(synthetic_act(spark, sf_dir))


def child_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = synthetic_act(spark, sf_dir).where("ptype <> 'chapter'").drop("ordinal")
    return units.with_ordinals(nodes).select("node_id", "parent_id", "ordinal")


def article_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = integrity.kind_gaps(synthetic_act(spark, sf_dir))
    return found.select("doc_id", "kind", "n_found", F.size("gaps").alias("n_gaps"), F.try_element_at("gaps", F.lit(1)).alias("first_gap"))


def sequence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered points out of order; the paragraphs of the act have none, as the query shows by joining both checks."""
    nodes = tabled(synthetic_act(spark, sf_dir).select("doc_id", "node_id", "ptype", "local_id", "parent_id", "marker", "ordinal"))  # read three times below
    letters = integrity.letter_breaks(nodes).select("parent_id", F.array_join("found", ")(").alias("found"))
    return letters.union(integrity.paragraph_breaks(nodes).select("parent_id", F.array_join(F.col("found").cast("array<string>"), ",")))


def headingless_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.headingless_articles(synthetic_act(spark, sf_dir))


def _roots(spark: SparkSession, sf_dir: str, phase: str) -> DataFrame:
    nodes = synthetic_act(spark, sf_dir)
    documents = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("doc_id"), F.when(F.col("r_regionkey") == 1, "aia").otherwise(F.col("r_name")).alias("short_name"))
    return units.phased_roots(nodes, documents, units.profiles(spark)).where(F.col("phase") == phase).select("doc_id", "node_id", "seq")


def unit_plan_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roots(spark, sf_dir, "bootstrap")


def unit_plan_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roots(spark, sf_dir, "main")


def act_modals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.modal_counts(synthetic_act(spark, sf_dir))


def act_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.durations(synthetic_act(spark, sf_dir)).select("seq", "citation", "match")


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.normal_text(t).alias("plain"), text.normal_title(t).alias("letters"))


def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.furniture_counts(layout.lines(table(spark, sf_dir, "documents")))


def doc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the documents: the second lacks some, has words more in some and white space in others."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("D "), "doc_id").alias("citation"), F.col("doc_id").alias("seq"), F.concat(F.lit("d"), "doc_id").alias("node_id"), F.lit("").alias("heading"), "text")
    changed = F.when(F.col("seq") % 5 == 0, F.concat("text", F.lit(" more"))).when(F.col("seq") % 3 == 0, F.concat(F.lit("  "), "text")).otherwise(F.col("text"))
    return reconcile.compared(docs.where("seq % 11 <> 0"), docs.where("seq % 7 <> 0").withColumn("text", changed)).select("citation", "status", "first_id", "second_id")


def rows_of(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


_NODE = "node_id string, seq long, ptype string, citation string, parent_id string, marker string, is_normative boolean, text string"
LEGAL = [
    ("a", 1, "definition", "X Art. 3(1)", None, "num", True, "‘maker’ or ‘builder’ means: a person as defined in Article 4 of Regulation (EU) 2019/1020 who builds;"),
    ("b", 2, "definition", "X Art. 3(2)", None, "num", True, "‘risk’, in the sense of this act, means a chance of harm"),
    ("c", 3, "paragraph", "X Art. 5(1)", None, "paragraph", True, "Makers should report no later than two months after 3 days, see Directive 95/46/EC and Regulation (EC) No 765/2008."),
    ("d", 4, "recital", "X Recital (1)", None, "", False, "They may act within 5 days under Directive 95/46/EC."),
    ("e", 5, "article", "X Art. 9", None, "", True, "By 1 January 2026, Member States shall adopt and publish rules. They shall apply those measures from 2 February 2027. By 3 March 2028 the Commission reports."),
    ("f", 6, "article", "X Art. 10", None, "", True, "This Regulation shall apply from 4 April 2025. However, it shall apply from 5 May 2025 as follows, where the rest shall apply later:"),
    ("g", 7, "point", "X Art. 10(a)", "f", "letter", True, "Articles 5 to 7 shall apply from 6 June 2026;"),
    ("h", 8, "point", "X Art. 10(b)", "f", "letter", True, "no date here"),
    ("i", 9, "article", "X Art. 11", None, "", True, "Act X is repealed with effect from 7 July 2026."),
]


def _legal(spark: SparkSession) -> DataFrame:
    return rows_of(spark, _NODE, *LEGAL)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.definitions(_legal(spark))


def external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.external_references(_legal(spark))


def app_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _legal(spark)
    events = signals.dated_events(nodes).select("seq", "kind", F.lit(None).cast("string").alias("scope"), "date")
    listed = signals.listed_application_dates(nodes).select("seq", F.lit("applies_from"), "scope", "date")
    return events.union(listed).union(signals.application_dates(nodes).select("seq", F.lit("applies_from"), "scope", "date"))


def amend_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, "doc_id int, text string", (1, "REGULATION (EU) 2024/1 of a day\namending Regulations (EC) No 300/2008, (EU) No 167/2013 and Directive 2014/90/EU and repealing Directive 2001/1/EC THE EUROPEAN PARLIAMENT"), (2, "A decision of 2020 Having regard to amending Regulation (EU) 2019/1"), (3, None))
    return signals.title_amended_acts(docs)


def roman_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens, ones = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    found = spark.range(1, 90).select(F.concat(F.get(F.array(*map(F.lit, tens)), F.floor(F.col("id") / 10).cast("int")), F.get(F.array(*map(F.lit, ones)), (F.col("id") % 10).cast("int"))).alias("numeral"))
    return found.union(rows_of(spark, "numeral string", ("XC",), ("a",), (None,))).select("numeral", text.roman_value(F.col("numeral")).alias("value"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "marker string, before string", ("(1)", None), ("(i)", None), ("(i)", "h"), ("(ii)", None), ("‘(b)", None), ("1.2.", None), ("3.", None), ("–", None), ("x)", None))
    return rows.select("marker", "before", text.page_marker(F.col("marker"), F.col("before")).alias("kind"), text.number(F.col("marker"), F.lit(9)).alias("number"), text.item_marker(text.number(F.col("marker"), F.lit(9))).alias("item"))


def layout_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of every kind, and lines that are none, rendered from lines of orders."""
    q, mode = F.col("l_quantity").cast("int"), F.col("l_linestatus")
    shapes = [F.concat(F.lit("  "), q, F.lit(".1. "), mode), F.concat(F.lit("  "), q, F.lit(". ")), F.concat(F.lit("  ("), q, F.lit(") "), mode), F.concat(F.lit("  (iv) "), F.lower(mode)), F.concat(F.lit("  ("), F.char(97 + q % 26), F.lit(") x")), F.concat(F.lit("  "), F.when(q % 2 == 1, "—").otherwise("–"), F.lit(" "), mode)]
    line = F.coalesce(F.try_element_at(F.array(*shapes), F.col("l_linenumber").cast("int")), F.lit(" (b) near"))
    m = text.layout_marker(line)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m["kind"].alias("kind"), m["label"].alias("label"), m["rest"].alias("rest"))


def names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "path string, slug string", ("/a/B.PDF", "risk-level"), ("b.htm", "x"), ("c.fmx", "a-b-c"), ("d.txt", ""), ("noname", None))
    act = F.concat(F.lit("Regulation (EU) No 12/2020 and 95/46/EC for "), "path")
    return rows.select("path", text.source_format(F.col("path")).alias("format"), text.topic_label(F.col("slug")).alias("label"), text.file_name(F.col("path")).alias("file"), text.target_act(act).alias("act"), text.version_id(F.lit(None).cast("string"), F.col("path"), text.source_hash(F.lit("a"))).alias("version"), text.redacted(F.concat(F.lit("bad: "), "path", F.lit("\nmore")), F.array(F.lit("/a/B.PDF"), F.lit("x" * 30))).alias("told"))


PAGES = [
    "Official Journal\n  EN  OJ L, 1.2.2024\nTitle of the act\nIt refers (1) to law and point (2) too.\n  (1) Regulation (EU) 2019/1\nmore of the note\n\f  ELI: http://x 1/2\n   (3) starts a list\n   (5) no note\nArticle 1      Annex II\n  Article 2     -\n  Articles 3 and 4     Article 7(1)",
    None,
]


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, "doc_id int, text string", *enumerate(PAGES))
    return layout.without_footnotes(layout.without_furniture(layout.lines(docs)))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, "doc_id int, text string", *enumerate(PAGES))
    return layout.correlations(layout.lines(docs))


def letter_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows_of(spark, "doc_id int, page_no int, line_no int, line string", (1, 0, 0, " " * 22 + "HAV E AD OPTE D TH IS"), (1, 0, 1, "plain line"), (1, 0, 2, " " * 22 + "NO REF ER EN CE"))
    known = rows_of(spark, "doc_id int, page_no int, line_no int, line string", (1, 0, 0, "Have adopted this"), (1, 0, 5, "HAVE ADOPTED THIS"))
    return layout.repaired(found, known)


FORMEX = """<ACT xmlns="http://example.org/f"><PREAMBLE><RECITAL><NO.RECITAL>(1)</NO.RECITAL><TXT>Legal acts require clear structure.</TXT></RECITAL></PREAMBLE>
<BODY><CHAPTER><NO.CHAPTER>I</NO.CHAPTER><TI.CHAPTER><TI>General</TI></TI.CHAPTER><ARTICLE><TI.ART><NO.ART>Article 1</NO.ART><TI>Purpose</TI></TI.ART>
<PARAG><NO.PARAG>1.</NO.PARAG><ALINEA>Manufacturers shall act.</ALINEA><LIST><ITEM><NO.POINT>(a)</NO.POINT><ALINEA>Keep records.</ALINEA></ITEM></LIST></PARAG></ARTICLE></CHAPTER></BODY></ACT>"""


def _formex(spark: SparkSession) -> DataFrame:
    return formex.act_nodes(rows_of(spark, "doc_id string, short_name string, content binary", ("d", "TEST", FORMEX.encode())))


def xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formex(spark).select("seq", "node_id", "ptype", "local_id", "citation", "parent_id", "heading", "text", "is_normative", "marker")


ACT_PAGE = """<html><body><div id="rct_1"><table><tr><td>(1)</td><td>Legal acts <a class="oj-note-tag">(1)</a> require clear structure.</td></tr></table></div>
<div id="cpt_I"><div class="eli-title"><p>General</p></div><div id="art_1"><div class="eli-title"><p>Purpose</p></div><div id="001.001"><p class="oj-normal">1.   Manufacturers shall act.</p>
<table><tr><td><p class="oj-normal">(a)</p></td><td><p class="oj-normal">Keep records.</p></td></tr></table><p class="oj-normal">They shall keep them.</p></div></div></div>
<div class="eli-container" id="anx_I"><p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">Products</p><p class="oj-ti-grseq-1">Part A</p><p class="oj-ti-grseq-1">Tools</p><table><tr><td>1.</td><td><p>Saws</p></td></tr><tr><td>1.</td><td><p>Drills</p></td></tr></table></div></body></html>"""


def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = act_html.act_nodes(rows_of(spark, "doc_id string, short_name string, content string", ("d", "TEST", ACT_PAGE)))
    return nodes.select("seq", "node_id", "ptype", "citation", "parent_id", "heading", "text", "marker")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the table read as an act. As none is one, each has its preamble alone."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("PAGE").alias("short_name"), F.col("html").alias("content"))
    return act_html.act_nodes(pages).select("doc_id", "node_id", "ptype", "text")


def xml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the parsed act: one bootstrap unit of three provisions and no main unit."""
    documents = rows_of(spark, "doc_id string, short_name string", ("d", "TEST"))
    return units.plan_listing(units.extraction_units(_formex(spark), documents, units.profiles(spark)))


_TREE = "doc_id string, node_id string, seq int, ptype string, local_id string, citation string, parent_id string, heading string, text string, is_normative boolean"
PACKED = [
    ("d", "a1", 1, "article", "1", "X Art. 1", None, "Scope", "x" * 10, True), ("d", "p1", 2, "paragraph", "1", "X Art. 1(1)", "a1", "", "x" * 40, True), ("d", "p2", 3, "paragraph", "2", "X Art. 1(2)", "a1", "", "x" * 45, True), ("d", "p3", 4, "paragraph", "3", "X Art. 1(3)", "a1", "", "x" * 5, True),
    ("d", "a7", 5, "article", "7", "X Art. 7", None, "Definitions", "", True), ("d", "a8", 6, "article", "8", "X Art. 8", None, "", "x" * 500, True),
    ("d", "n1", 7, "annex", "III", "X ANNEX III", None, "", "own", True), ("d", "g1", 8, "part", "A", "X ANNEX III Part A", "n1", "", "x" * 20, True), ("d", "n2", 9, "annex", "II", "X ANNEX II", None, "", "x", True), ("d", "n3", 10, "table_annex", "V", "X ANNEX V", None, "", "x", True),
]


def unit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, documents = rows_of(spark, _TREE, *PACKED), rows_of(spark, "doc_id string, short_name string", ("d", "cra"))
    return units.extraction_units(nodes, documents, units.profiles(spark), max_chars=100).select("phase", "root_id", "part", "ordinal", "node_id")


def unit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, documents = rows_of(spark, _TREE, *PACKED[4:]), rows_of(spark, "doc_id string, short_name string", ("d", "cra"))
    dates = rows_of(spark, "doc_id string, provision string, kind string, date string", ("d", "X Art. 8", "applies_from", "1 May 2025"), ("d", "g1", "dated_task", "2 May 2025"), ("d", "X Art. 99", "dated_task", "3 May 2025"))
    found = units.unit_contexts(units.extraction_units(nodes, documents, units.profiles(spark)), nodes, dates)
    get = lambda path: F.get_json_object("context", path)
    return found.select("unit_id", get("$.provisions[0].id").alias("first"), get("$.applicationDates[0].date").alias("date"))


RULES = [
    ("r1", '{"all": [{"q": "a", "op": "is_true"}, {"not": {"q": "b", "op": "eq", "value": "x"}}]}'),
    ("r2", '{"any": [{"q": "n", "op": "gte", "value": 10}, {"q": "m", "op": "contains", "value": ["u"]}]}'),
    ("r3", '{"not": {"not": {"q": "missing", "op": "is_true"}}}'),
    ("r4", '{"all": []}'),
    ("r5", '{"any": [{"q": "a", "op": "is_false"}, {"q": "missing", "op": "is_true"}, {"all": [{"q": "n", "op": "lt", "value": 9.5}, {"q": "b", "op": "in", "value": ["y", "z"]}]}]}'),
]
ANSWERS = [("s", "a", "true"), ("s", "b", '"y"'), ("s", "n", "9"), ("s", "m", '["u", "v"]'), ("t", "a", "false"), ("t", "b", '"x"'), ("t", "n", "12")]


def condition_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, answers = rows_of(spark, "rule_id string, condition string", *RULES), rows_of(spark, "assessment_id string, q string, answer string", *ANSWERS)
    pairs = rows_of(spark, "assessment_id string, rule_id string", *((a, r) for a in "st" for r, _ in RULES))
    return conditions.evaluated(rules, pairs, answers)


def condition_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.leaves(rows_of(spark, "rule_id string, condition string", *RULES, ("r6", None), ("r7", "{broken"))).select("rule_id", "place", "q", "op")


def questions_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = rows_of(spark, "q string, ask_if string", ("q1", None), ("q2", RULES[0][1]), ("q3", RULES[2][1]))
    pairs = rows_of(spark, "assessment_id string, q string", *((a, f"q{i}") for a in "st" for i in (1, 2, 3)))
    return conditions.asked(questions, pairs, rows_of(spark, "assessment_id string, q string, answer string", *ANSWERS))


def operator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rows_of(spark, "rule_id string, condition string", *RULES)
    return conditions.operator_errors(rules, rows_of(spark, "q string, answer_type string", ("a", "number"), ("b", "single_choice"), ("n", "date"), ("m", "boolean")))


def question_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "d", "a"), ("h", "a", "b"), ("h", "b", "c"), ("k", "z", "z")]
    return conditions.cyclic_questions(rows_of(spark, "group_id string, q string, needs string", *edges))


_GOOD = '{"packageVersion": "1.0", "document": {"id": "kg:x", "shortName": "X"}, "unit": {"provisionId": "x:1"}, "provisions": [{"id": "x:1", "isNormative": true}, {"id": "x:2", "isNormative": false}], "roles": [{"id": "x:role.maker"}], "topicsProposed": [], "statements": [%s], "questions": [%s]%s}'
_STATEMENT = '{"id": "%s", "type": "%s", "modality": "%s", "derivedFrom": [%s], "evidence": "%s", "addressees": [%s], "topics": [%s]%s}'
PACKAGES = [
    ("ok", _GOOD % (_STATEMENT % ("x:st.a", "Obligation", "shall", '"x:1"', "shall  ACT within two days", '"x:role.maker"', '"kg:topic.t"', ', "deadline": {"duration": "P2D"}, "applicability": null'), "", "")),
    ("bad", _GOOD % (
        ", ".join([
            _STATEMENT % ("y:st.b", "Permission", "may", '"x:9"', "z", "", "", ""), _STATEMENT % ("x:st.c", "Prohibition", "shall_not", '"x:2"', "not there", "", '"kg:topic.u"', ', "deadline": {"duration": "P12M"}'),
            _STATEMENT % ("x:st.c", "Exemption", "any", '"x:1"', "Makers", "", "", ', "applicability": {"any": [{"q": "kg:question.one", "op": "gt", "value": 1}, {"q": "kg:q.none", "op": "eq", "value": 1}]}'),
        ]),
        '{"id": "kg:q.one", "source": "x:1", "status": "new", "answerType": "boolean", "askIf": {"q": "kg:q.two", "op": "is_true"}}, {"id": "kg:q.two", "source": "x:7", "status": "existing", "answerType": "single_choice", "options": [], "askIf": {"q": "kg:q.one", "op": "eq", "value": true}}',
        ', "definitions": [{"id": "x:def.d", "definedIn": "x:5"}], "documentScope": {"q": "kg:q.lost", "op": "eq", "value": 1}',
    )),
    ("torn", '{"packageVersion": "1.0", "document": {"id": "kg:x"}}'),
]


def _packages(spark: SparkSession) -> DataFrame:
    return packages.normalised(packages.readable(rows_of(spark, "package_id string, json string", *PACKAGES, ("old", '{"packageVersion": "0.9"}'), ("none", "{"))))


def package_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [("x:1", "Makers shall act within two days."), ("x:2", "Considering.")]
    sources = rows_of(spark, "package_id string, node_id string, text string", *((p, *t) for p in ("ok", "bad", "torn") for t in texts))
    return packages.findings(_packages(spark), sources, rows_of(spark, "id string", ("kg:topic.t",)), rows_of(spark, "q string, answer_type string", ("kg:q.none", "number")))


def unit_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = rows_of(spark, "package_id string, document_id string, root_id string, node_ids array<string>", ("ok", "kg:x", "x:1", ["x:2", "x:1"]), ("bad", "kg:x", "x:1", ["x:1"]), ("torn", "kg:y", "x:1", ["x:1"]))
    return packages.unit_mismatches(packages.parsed(_packages(spark)), expected)


def catalog_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows_of(spark, "package_id string, seq int, json string", ("a", 1, '{"roles": [{"id": "r1", "label": "x"}, {"id": "r2"}], "questions": [{"id": "q1"}]}'), ("b", 2, '{"roles": [{"label": "x", "id": "r1"}, {"id": "r1", "label": "y"}], "topicsProposed": [{"id": "t"}], "definitions": [{"termId": "d"}]}'))
    return packages.catalog(found)


def unknown_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.unknown_topics(rows_of(spark, "topics array<string>", (["kg:topic.a-b", "kg:topic.known", "kg:topic.A", "loose"],), (["kg:topic.a-b", "x:topic.new"],)), rows_of(spark, "topic_id string", ("kg:topic.known",)))


def recovered_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within answers that go on after them in four ways."""
    after = F.element_at(F.array(*map(F.lit, (" see [2]", ' then {"b": 2}', " } more", ", and so on"))), (F.col("doc_id") % 4 + 1).cast("int"))
    answers = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('Answer: {broken {"id": '), "doc_id", F.lit(', "t": "}"}'), after).alias("answer"))
    return answers.select("doc_id", packages.recovered("answer").alias("json"))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "doc_id int, eli_uri string, canonical string, title string, detected_title string", (1, "http://e/1/", "http://e/1", "An Act", "Draft: AN ACT (final)"), (2, "http://e/1", "http://e/2", "An Act", "Other"), (3, None, None, "An Act", "L_202401234EN.01000101.fmx.xml"), (4, None, "x", "An Act", None))
    return integrity.declaration_errors(rows)


OWN = ("rk:", "https://example.org/o#")


def external_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship names: nations of even regions are properties of the own name space, others of another vocabulary."""
    space = F.when(F.col("n_regionkey") % 2 == 0, OWN[1]).otherwise("http://www.w3.org/ns/prov#")
    none = F.lit(None).cast("string")
    triples = table(spark, sf_dir, "nation").select(F.concat(space, "n_name").alias("s"), F.lit(f"{OWN[1]}lpgRelationship").alias("p"), F.concat(F.lit("IN_"), "n_name").alias("o"), none.alias("lang"))
    return ontology.external_relationships(triples, OWN)


def _values(columns: str, *rows: tuple) -> str:
    """SQL of fixed rows; columns are names with DuckDB's types."""
    def literal(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    names = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {body}) t({', '.join(n for n, _ in names)})"


_LINES = "SELECT doc_id, page_no, line_no, line"
ORACLE_SQL: dict[str, str] = {
    "act_nodes": f"WITH {_ACT} SELECT * FROM act",
    "node_type_histogram": f"WITH {_ACT} SELECT doc_id, ptype, count(*) AS n FROM act GROUP BY 1, 2",
    "child_ordinals": f"WITH {_ACT} SELECT node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY seq) - 1 AS INTEGER) AS ordinal FROM act WHERE ptype <> 'chapter'",
    "article_gaps": f"""WITH {_ACT}, k AS (SELECT DISTINCT doc_id, CAST(local_id AS INTEGER) AS n FROM act WHERE ptype = 'article'), m AS (SELECT doc_id, count(*) AS c, max(n) AS top FROM k GROUP BY 1),
        g AS (SELECT doc_id, unnest(range(1, top + 1)) AS n FROM m), l AS (SELECT g.* FROM g ANTI JOIN k USING (doc_id, n))
        SELECT m.doc_id, 'article' AS kind, m.c AS n_found, CAST(count(l.n) AS INTEGER) AS n_gaps, CAST(min(l.n) AS INTEGER) AS first_gap FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL""",
    "sequence_errors": f"""WITH {_ACT}, s AS (SELECT parent_id, string_agg(local_id, ')(' ORDER BY ordinal) AS found, string_agg(chr(97 + ordinal), ')(' ORDER BY ordinal) AS wanted FROM act WHERE marker = 'letter' GROUP BY 1)
        SELECT parent_id, found FROM s WHERE found <> wanted""",
    "headingless_articles": f"WITH {_ACT} SELECT doc_id, citation FROM act WHERE ptype = 'article' AND heading IS NULL",
    "unit_plan_bootstrap": f"WITH {_ACT} SELECT doc_id, node_id, seq FROM act WHERE ptype = 'article' AND (local_id IN ('1', '2', '3') OR doc_id = 'r1' AND local_id IN ('5', '6'))",
    "unit_plan_main": f"WITH {_ACT} SELECT doc_id, node_id, seq FROM act WHERE ptype = 'article' AND NOT (local_id IN ('1', '2', '3') OR doc_id = 'r1' AND local_id IN ('5', '6'))",
    "act_modals": f"WITH {_ACT} SELECT regexp_extract(text, 'shall|may') AS modal, count(*) AS n FROM act WHERE regexp_matches(text, '\\b(shall|may)\\b') GROUP BY 1",
    "act_durations": f"WITH {_ACT} SELECT seq, citation, regexp_extract(text, 'within \\d+ days') AS match FROM act WHERE ptype = 'point'",
    "text_normalise": r"""SELECT doc_id, regexp_replace(trim(regexp_replace(translate(replace(text, chr(173), ''), '‘’“”–—−', '''''""---'), '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g')), '\s*([,;().:])\s*', '\1', 'g') AS plain, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS letters FROM documents""",
    "line_clean": "SELECT doc_id, CAST(0 AS BIGINT) AS furniture, CAST(len(string_split(text, chr(10))) AS BIGINT) AS kept FROM documents WHERE text IS NOT NULL",
    "doc_diff": """WITH a AS (SELECT * FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT * FROM documents WHERE doc_id % 7 <> 0)
        SELECT 'D ' || coalesce(a.doc_id, b.doc_id) AS citation, CASE WHEN b.doc_id IS NULL THEN 'first_only' WHEN a.doc_id IS NULL THEN 'second_only' WHEN a.doc_id % 5 = 0 THEN 'different' ELSE 'identical' END AS status,
            'd' || a.doc_id AS first_id, 'd' || b.doc_id AS second_id FROM a FULL JOIN b USING (doc_id)""",
    "definitions": _values("citation VARCHAR, term VARCHAR, alias VARCHAR, by_reference VARCHAR", ("X Art. 3(1)", "maker", "builder", "Article 4 of Regulation (EU) 2019/1020"), ("X Art. 3(2)", "risk", None, None)),
    "external_refs": _values("act VARCHAR, n BIGINT, first_seq BIGINT", ("Regulation (EU) 2019/1020", 1, 1), ("Directive 95/46/EC", 2, 3), ("Regulation (EC) 765/2008", 1, 3)),
    "app_dates": _values("seq BIGINT, kind VARCHAR, scope VARCHAR, date VARCHAR", (5, "transposition_deadline", None, "1 January 2026"), (5, "national_measures_apply_from", None, "2 February 2027"), (5, "dated_task", None, "3 March 2028"), (6, "applies_from", "This Regulation", "4 April 2025"), (6, "applies_from", "This Regulation", "5 May 2025"), (7, "applies_from", "Articles 5 to 7", "6 June 2026"), (9, "with_effect_from", None, "7 July 2026")),
    "amend_title": _values("doc_id INTEGER, act VARCHAR", (1, "300/2008"), (1, "167/2013"), (1, "2014/90/EU")),
    "roman_values": "WITH t(i) AS (SELECT unnest(range(1, 90))) SELECT ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX'][i // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][i % 10 + 1] AS numeral, CAST(i AS INTEGER) AS value FROM t UNION ALL VALUES ('XC', NULL), ('a', NULL), (NULL, NULL)",
    "markers": _values("marker VARCHAR, before VARCHAR, kind VARCHAR, number VARCHAR, item VARCHAR", ("(1)", None, "num", "1", "num"), ("(i)", None, "roman", "i", "letter"), ("(i)", "h", "letter", "i", "letter"), ("(ii)", None, "roman", "ii", "roman"), ("‘(b)", None, "letter", "b", "letter"), ("1.2.", None, "decimal", "1.2", ""), ("3.", None, "paragraph", "3", "num"), ("–", None, "dash", "9", "num"), ("x)", None, "other", "x", "letter")),
    "layout_markers": """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'decimal' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'num' WHEN 4 THEN 'roman' WHEN 5 THEN CASE WHEN q % 26 IN (8, 21, 23) THEN 'roman' ELSE 'letter' END WHEN 6 THEN CASE WHEN q % 2 = 1 THEN 'dash' END END AS kind,
        CASE l_linenumber WHEN 1 THEN q || '.1' WHEN 2 THEN CAST(q AS VARCHAR) WHEN 3 THEN CAST(q AS VARCHAR) WHEN 4 THEN 'iv' WHEN 5 THEN chr(97 + q % 26) WHEN 6 THEN CASE WHEN q % 2 = 1 THEN '—' END END AS label,
        CASE l_linenumber WHEN 1 THEN l_linestatus WHEN 2 THEN '' WHEN 3 THEN l_linestatus WHEN 4 THEN lower(l_linestatus) WHEN 5 THEN 'x' WHEN 6 THEN CASE WHEN q % 2 = 1 THEN l_linestatus END END AS rest FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""",
    "names_and_ids": _values("path VARCHAR, format VARCHAR, label VARCHAR, file VARCHAR, act VARCHAR, version VARCHAR, told VARCHAR", *((p, f, l, n, "12/2020", f"{p}:v-ca978112ca1bbdca", f"bad: {p}") for p, f, l, n in (("/a/B.PDF", "pdf", "Risk Level", "_a_B.PDF.json"), ("b.htm", "html", "X", "b.htm.json"), ("c.fmx", "fmx", "A B C", "c.fmx.json"), ("d.txt", None, "", "d.txt.json"), ("noname", None, None, "noname.json")))),
    "layout_lines": _values("doc_id INTEGER, page_no INTEGER, line_no INTEGER, line VARCHAR", (0, 0, 2, "Title of the act"), (0, 0, 3, "It refers (1) to law and point (2) too."), *((0, 1, n, x) for n, x in ((1, "   (3) starts a list"), (2, "   (5) no note"), (3, "Article 1      Annex II"), (4, "  Article 2     -"), (5, "  Articles 3 and 4     Article 7(1)")))),
    "correlations": _values("doc_id INTEGER, page_no INTEGER, line_no INTEGER, repealed VARCHAR, this_act VARCHAR", (0, 1, 4, "Article 2", None), (0, 1, 5, "Articles 3 and 4", "Article 7(1)")),
    "letter_spacing": _values("doc_id INTEGER, page_no INTEGER, line_no INTEGER, line VARCHAR, fixed BOOLEAN", (1, 0, 0, " " * 22 + "HAVE ADOPTED THIS", True), (1, 0, 1, "plain line", False), (1, 0, 2, " " * 22 + "NO REF ER EN CE", False)),
    "xml_parse": _values("seq INTEGER, node_id VARCHAR, ptype VARCHAR, local_id VARCHAR, citation VARCHAR, parent_id VARCHAR, heading VARCHAR, text VARCHAR, is_normative BOOLEAN, marker VARCHAR", (0, "test:preamble", "preamble", "pre", "TEST Preamble", None, "", "", False, ""), (1, "test:rec_1", "recital", "1", "TEST Recital (1)", "test:preamble", "", "(1) Legal acts require clear structure.", False, ""), (2, "test:chap_I", "chapter", "I", "TEST Chapter I", "test:preamble", "General", "", True, ""), (3, "test:art_1", "article", "1", "TEST Art. 1", "test:chap_I", "Purpose", "", True, ""), (4, "test:art_1.par_1", "paragraph", "1", "TEST Art. 1(1)", "test:art_1", "", "Manufacturers shall act.", True, "paragraph"), (5, "test:art_1.par_1.point_a", "point", "a", "TEST Art. 1(1)(a)", "test:art_1.par_1", "", "Keep records.", True, "letter")),
    "html_parse": _values("seq INTEGER, node_id VARCHAR, ptype VARCHAR, citation VARCHAR, parent_id VARCHAR, heading VARCHAR, text VARCHAR, marker VARCHAR", (0, "test:preamble", "preamble", "TEST Preamble", None, "", "", ""), (1, "test:rec_1", "recital", "TEST Recital (1)", "test:preamble", "", "Legal acts require clear structure.", ""), (2, "test:chap_I", "chapter", "TEST Chapter I", None, "General", "", ""), (3, "test:art_1", "article", "TEST Art. 1", "test:chap_I", "Purpose", "", ""), (4, "test:art_1.par_1", "paragraph", "TEST Art. 1(1)", "test:art_1", "", "Manufacturers shall act.", "paragraph"), (5, "test:art_1.par_1.let_a", "point", "TEST Art. 1(1)(a)", "test:art_1.par_1", "", "Keep records.", "letter"), (6, "test:art_1.par_1.subpar_2", "subparagraph", "TEST Art. 1(1), subparagraph 2", "test:art_1.par_1", "", "They shall keep them.", "subpar"), (7, "test:anx_I", "annex", "TEST Annex I", None, "Products", "", ""), (8, "test:anx_I.part_A", "part", "TEST Annex I, Part A", "test:anx_I", "Tools", "", ""), (9, "test:anx_I.part_A.par_1", "paragraph", "TEST Annex I, Part A, point 1", "test:anx_I.part_A", "", "Saws", "paragraph"), (10, "test:anx_I.part_A.par_1~2", "paragraph", "TEST Annex I, Part A, point 1", "test:anx_I.part_A", "", "Drills", "paragraph")),
    "page_nodes": "SELECT CAST(page_id AS VARCHAR) AS doc_id, 'page:preamble' AS node_id, 'preamble' AS ptype, '' AS text FROM pages",
    "xml_units": _values("doc_id VARCHAR, phase VARCHAR, unit_id VARCHAR, n_nodes BIGINT", ("d", "bootstrap", "test:art_1", 3)),
    "unit_packing": _values("phase VARCHAR, root_id VARCHAR, part INTEGER, ordinal INTEGER, node_id VARCHAR", ("bootstrap", "a1", None, 0, "a1"), ("bootstrap", "a1", None, 1, "p1"), ("bootstrap", "a1", None, 2, "p2"), ("bootstrap", "a1", None, 3, "p3"), ("bootstrap", "a7", None, 0, "a7"), ("main", "a8", None, 0, "a8"), ("bootstrap", "g1", None, 0, "g1"), ("main", "n2", None, 0, "n2")),
    "unit_contexts": _values("unit_id VARCHAR, first VARCHAR, date VARCHAR", ("a7", "a7", None), ("a8", "a8", "1 May 2025"), ("g1", "g1", "2 May 2025"), ("n2", "n2", None)),
    "condition_eval": _values("assessment_id VARCHAR, rule_id VARCHAR, holds BOOLEAN", ("s", "r1", True), ("s", "r2", True), ("s", "r3", None), ("s", "r4", True), ("s", "r5", True), ("t", "r1", False), ("t", "r2", True), ("t", "r3", None), ("t", "r4", True), ("t", "r5", True)),
    "condition_leaves": _values("rule_id VARCHAR, place INTEGER, q VARCHAR, op VARCHAR", ("r1", 1, "a", "is_true"), ("r1", 3, "b", "eq"), ("r2", 1, "n", "gte"), ("r2", 2, "m", "contains"), ("r3", 2, "missing", "is_true"), ("r5", 1, "a", "is_false"), ("r5", 2, "missing", "is_true"), ("r5", 4, "n", "lt"), ("r5", 5, "b", "in")),
    "questions_asked": _values("assessment_id VARCHAR, q VARCHAR", ("s", "q1"), ("s", "q2"), ("t", "q1")),
    "operator_matrix": _values("rule_id VARCHAR, place INTEGER, q VARCHAR, op VARCHAR, answer_type VARCHAR", ("r1", 1, "a", "is_true", "number"), ("r2", 2, "m", "contains", "boolean"), ("r5", 1, "a", "is_false", "number")),
    "question_cycles": _values("group_id VARCHAR, q VARCHAR", ("g", "a"), ("g", "b"), ("g", "c"), ("k", "z")),
    "package_findings": _values("package_id VARCHAR, subject VARCHAR, rule VARCHAR", ("torn", None, "schema"), *(("bad", s, r) for s, r in (("x:st.c", "duplicate_statement"), ("y:st.b", "statement_id"), ("y:st.b", "derived_from"), ("x:st.c", "addressee"), ("x:st.c", "evidence"), ("x:st.c", "non_normative"), ("x:st.c", "deadline"), ("x:st.c", "unknown_reference"), ("x:st.c", "unknown_reference"), ("documentScope", "document_scope"), ("x:st.c", "operator"), ("kg:q.two", "question_source"), ("kg:q.two", "existing_question"), ("kg:q.two", "options"), ("kg:q.one", "operator"), (None, "cycle"), ("x:def.d", "defined_in")))),
    "unit_mismatches": _values("package_id VARCHAR, message VARCHAR", ("bad", "provisions must include exactly the selected unit nodes"), ("torn", "document.id does not match the parsed source")),
    "catalog_distinct": _values("kind VARCHAR, item VARCHAR, item_id VARCHAR, first INTEGER", ("roles", '{"id": "r1", "label": "x"}', "r1", 1), ("roles", '{"id": "r2"}', "r2", 1), ("questions", '{"id": "q1"}', "q1", 1), ("roles", '{"id": "r1", "label": "y"}', "r1", 2), ("topics", '{"id": "t"}', "t", 2), ("definitions", '{"termId": "d"}', "d", 2)),
    "unknown_topics": _values("topic_id VARCHAR, label VARCHAR", ("kg:topic.a-b", "A B"), ("x:topic.new", "New")),
    "recovered_packages": """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN '{"id": ' || doc_id || ', "t": "}"}' END AS json FROM documents""",
    "declared": _values("doc_id INTEGER, message VARCHAR", (2, "canonical address differs from the declared one"), (2, "source title differs from the declared one")),
    "external_vocabulary": "SELECT 'prov:' || n_name AS property, 'IN_' || n_name AS relationship FROM nation WHERE n_regionkey % 2 = 1",
}
#: Small texts with known answers, which tests hold; the queries of these names read texts rendered from the tables.
_SMALL = "definitions external_refs app_dates amend_title roman_values markers names_and_ids correlations catalog_distinct unknown_topics declared condition_eval condition_leaves operator_matrix question_cycles".split()
SMALL: dict[str, tuple[Query, str]] = {name: (globals()[name], ORACLE_SQL.pop(name)) for name in _SMALL}
QUERIES: dict[str, Query] = {name: globals()[name] for name in ORACLE_SQL}
