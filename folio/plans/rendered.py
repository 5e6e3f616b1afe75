"""Queries over sentences, markers, names and packages that are rendered from the tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import conditions, integrity, packages, signals
from ..sources import layout
from ..sources.tables import table


def _told(*pieces: str, angles: bool = False) -> Column:
    """A text in which names in braces are columns; of several texts the one whose place is the column `_form`. With `angles`, angle brackets of the text are told as braces."""
    def one(piece: str) -> Column:
        plain = lambda part: part.replace("<", "{").replace(">", "}") if angles else part
        return F.concat(*(F.col(part).cast("string") if i % 2 else F.lit(plain(part)) for i, part in enumerate(piece.replace("}", "{").split("{"))))

    if len(pieces) == 1:
        return one(pieces[0])
    chosen = F.lit(None).cast("string")
    for i, piece in reversed(list(enumerate(pieces))):
        chosen = F.when(F.col("_form") == i, one(piece)).otherwise(chosen)
    return chosen


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as defined terms: with another name and by reference, plainly, and in nodes that define nothing."""
    told = _told("‘{p_name}’ or ‘{p_brand}’ means: an item as defined in Article {p_size} of Regulation (EU) 2019/{p_partkey} of a kind;", "‘{p_name}’, in the sense of this act, means a thing", "‘{p_name}’ means nothing here")
    nodes = table(spark, sf_dir, "part").withColumn("_form", F.col("p_partkey") % 3)
    return signals.definitions(nodes.select(F.when(F.col("_form") == 2, "paragraph").otherwise("definition").alias("ptype"), F.concat(F.lit("X Art. 3("), "p_partkey", F.lit(")")).alias("citation"), told.alias("text")))


def external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumns({"_a": F.col("l_suppkey") % 90 + 10, "_b": F.col("l_quantity").cast("int") + 100})
    return signals.external_references(lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), _told("It acts under Directive {_a}/46/EC and Regulation (EC) No {_b}/2008, see Directive {_a}/46/EC.").alias("text")))


def app_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in three kinds of sentences; every fourth order says none."""
    orders = table(spark, sf_dir, "orders").withColumns({"_form": F.col("o_orderkey") % 4, "_d": F.col("o_custkey") % 28 + 1, "_y": F.col("o_orderkey") % 50 + 2000})
    told = _told("By {_d} January {_y}, Member States shall adopt and publish rules.", "Act X is repealed with effect from {_d} July {_y}.", "This Regulation shall apply from {_d} April {_y}. However, it shall apply from {_d} May {_y}.", "It has no date.")
    nodes = orders.select(F.col("o_orderkey").alias("seq"), F.lit("X").alias("citation"), told.alias("text"))
    events = signals.dated_events(nodes).select("seq", "kind", F.lit(None).cast("string").alias("scope"), "date")
    return events.union(signals.application_dates(nodes).select("seq", F.lit("applies_from"), "scope", "date"))


def amend_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({"_form": F.col("o_orderkey") % 3, "_a": F.col("o_custkey") % 900 + 100, "_b": F.col("o_orderkey") % 900 + 100})
    told = _told("REGULATION (EU) 2024/1 of a day\namending Regulations (EC) No {_a}/2008, (EU) No {_b}/2013 and Directive 2014/{_a}/EU and repealing Directive 2001/1/EC THE EUROPEAN PARLIAMENT", "A decision Having regard to amending Regulation (EU) 2019/{_a}", "Decision amending Regulation (EU) {_a}/2019 (Text with EEA relevance) and {_b}/2020")
    return signals.title_amended_acts(orders.select(F.col("o_orderkey").alias("doc_id"), told.alias("text")))


def roman_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals up to 89 of parts; every ninetieth is no numeral."""
    tens, ones = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    n = F.col("p_partkey") % 90
    digit = lambda signs, at: F.get(F.array(*map(F.lit, signs)), at.cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(n == 0, "XIa").otherwise(F.concat(digit(tens, F.floor(n / 10)), digit(ones, n % 10))).alias("numeral"))
    return parts.withColumn("value", text.roman_value(F.col("numeral")))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of seven kinds from lines of orders; of letters every second follows the one before it."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"_q": F.col("l_quantity").cast("int"), "_form": (F.col("l_linenumber") - 1) % 7})
    lines = lines.withColumns({"_c": F.char(97 + F.col("_q") % 26), "before": F.when(F.col("_q") % 2 == 0, F.char(96 + F.col("_q") % 26))})
    rows = lines.select("l_orderkey", "l_linenumber", _told("({_q})", "({_c})", "{_q}.1.", "{_q}.", "–", "x)", "‘(ii)").alias("marker"), "before")
    n = text.number(F.col("marker"), F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "marker", text.page_marker(F.col("marker"), F.col("before")).alias("kind"), n.alias("number"), text.item_marker(n).alias("item"))


def names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("_form", F.col("p_partkey") % 5)
    parts = parts.withColumn("path", _told("/{p_brand}/{p_partkey}.PDF", "{p_partkey}.htm", "{p_partkey}.fmx", "{p_partkey}.txt", "{p_partkey} of  {p_brand}"))
    act = F.concat(F.lit("Regulation (EU) No "), "p_partkey", F.lit("/2020 and 95/46/EC for "), "path")
    return parts.select("path", text.source_format(F.col("path")).alias("format"), text.topic_label(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("label"), text.file_name(F.col("path")).alias("file"), text.target_act(act).alias("act"), text.version_id(F.lit(None).cast("string"), F.col("path"), text.source_hash(F.col("p_name"))).alias("version"))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two columns from lines of orders: articles, an annex against a dash, and what is no such row."""
    lines = table(spark, sf_dir, "lineitem").withColumn("_form", F.col("l_linenumber") % 4)
    told = _told("  Article {l_partkey}     Articles {l_suppkey} and 9", "  Annex {l_partkey}   –", " Article {l_partkey}     Article {l_suppkey}", "  Article {l_partkey}  Article {l_suppkey}")
    return layout.correlations(lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").cast("int").alias("line_no"), told.alias("line")))


def catalog_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of orders: a customer is a role, told with its keys in both orders, a priority a question, the segment a term."""
    orders = table(spark, sf_dir, "orders")
    json = _told('<"roles": [<"id": "r{o_custkey}", "label": "x">, <"label": "x", "id": "r{o_custkey}">], "questions": [<"id": "{o_orderpriority}">], "definitions": [<"termId": "d">]>', angles=True)
    return packages.catalog(orders.select(F.col("o_orderkey").cast("string").alias("package_id"), F.col("o_orderkey").alias("seq"), json.alias("json")))


def unknown_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with sizes are topics, those of even sizes known; half of the others have an id in another form."""
    parts = table(spark, sf_dir, "part").withColumn("topic_id", F.concat(F.lit("kg:topic."), F.replace(F.when(F.col("p_size") % 4 == 1, F.col("p_brand")).otherwise(F.lower("p_brand")), F.lit("#"), F.lit("-")), F.lit("-"), "p_size"))
    return packages.unknown_topics(parts.select(F.array("topic_id", F.lit("loose")).alias("topics")), parts.where("p_size % 2 = 0").select("topic_id").distinct())


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose declared addresses differ by a slash or a letter, and whose titles stand in what is detected or not."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/")).alias("eli_uri"), F.when(n % 3 == 0, F.col("url")).when(n % 3 == 1, F.concat("url", F.lit("x"))).alias("canonical"), F.concat(F.lit("An Act "), n).alias("title"), F.when(n % 4 == 0, F.concat(F.lit("Draft: AN ACT, "), n, F.lit(" (final)"))).when(n % 4 == 1, "Other").when(n % 4 == 2, "L_202401234EN.01000101.fmx.xml").alias("detected_title"))
    return integrity.declaration_errors(pages.withColumnRenamed("page_id", "doc_id"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _told('<"all": [<"q": "n", "op": "gte", "value": {p_size}>, <"any": [<"q": "b", "op": "eq", "value": "{p_brand}">, <"not": <"q": "open", "op": "is_true">>]>]>', angles=True)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), told.alias("condition"))


def condition_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of parts for the customers that ordered them; each customer answers two of three questions."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = orders.select(F.col("o_custkey").cast("string").alias("assessment_id"), F.col("l_partkey").cast("string").alias("rule_id"))
    answers = F.posexplode(F.array((F.col("c_nationkey") * 2).cast("string"), F.concat(F.lit('"Brand#'), F.col("c_nationkey") + 1, F.lit('"')))).alias("at", "answer")
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("assessment_id"), answers).select("assessment_id", F.when(F.col("at") == 0, "n").otherwise("b").alias("q"), "answer")
    return conditions.evaluated(_rules(spark, sf_dir), pairs, answers)


def condition_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.leaves(_rules(spark, sf_dir))


def operator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part asks with one of three operators for the question of its size, which takes one of three kinds of answers."""
    parts = table(spark, sf_dir, "part")
    of = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n % 3 + 1).cast("int"))
    rules = parts.select(F.col("p_partkey").cast("string").alias("rule_id"), F.concat(F.lit('{"q": "s'), "p_size", F.lit('", "op": "'), of(F.col("p_partkey"), "gte", "is_true", "contains"), F.lit('"}')).alias("condition"))
    return conditions.operator_errors(rules, parts.select(F.concat(F.lit("s"), "p_size").alias("q"), of(F.col("p_size"), "number", "boolean", "multi_choice").alias("answer_type")).distinct())


def question_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order are questions that need the next one; of every third order the last needs the first."""
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(by_order).alias("k"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    needs = F.when(F.col("k") < F.col("n"), F.col("k") + 1).when(F.col("l_orderkey") % 3 == 0, 1)
    return conditions.cyclic_questions(lines.select(F.col("l_orderkey").alias("group_id"), F.col("k").cast("string").alias("q"), needs.cast("string").alias("needs")).where("needs is not null"))


ORACLE_SQL: dict[str, str] = {
    "definitions": """SELECT 'X Art. 3(' || p_partkey || ')' AS citation, p_name AS term, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS alias,
        CASE WHEN p_partkey % 3 = 0 THEN 'Article ' || p_size || ' of Regulation (EU) 2019/' || p_partkey END AS by_reference FROM part WHERE p_partkey % 3 < 2""",
    "external_refs": """WITH r AS (SELECT l_orderkey * 100 + l_linenumber AS seq, unnest(['Directive ' || a || '/46/EC', 'Directive ' || a || '/46/EC', 'Regulation (EC) ' || b || '/2008']) AS act
            FROM (SELECT *, l_suppkey % 90 + 10 AS a, CAST(l_quantity AS INTEGER) + 100 AS b FROM lineitem))
        SELECT act, count(*) AS n, min(seq) AS first_seq FROM r GROUP BY 1""",
    "app_dates": """WITH o AS (SELECT o_orderkey AS seq, o_orderkey % 4 AS f, CAST(o_custkey % 28 + 1 AS VARCHAR) AS d, CAST(o_orderkey % 50 + 2000 AS VARCHAR) AS y FROM orders)
        SELECT seq, 'transposition_deadline' AS kind, CAST(NULL AS VARCHAR) AS scope, d || ' January ' || y AS date FROM o WHERE f = 0 UNION ALL SELECT seq, 'with_effect_from', NULL, d || ' July ' || y FROM o WHERE f = 1
        UNION ALL SELECT seq, 'applies_from', 'This Regulation', d || unnest([' April ', ' May ']) || y FROM o WHERE f = 2""",
    "amend_title": """WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS f, o_custkey % 900 + 100 AS a, o_orderkey % 900 + 100 AS b FROM orders)
        SELECT doc_id, unnest([a || '/2008', b || '/2013', '2014/' || a || '/EU']) AS act FROM o WHERE f = 0 UNION ALL SELECT doc_id, a || '/2019' FROM o WHERE f = 2""",
    "roman_values": """SELECT p_partkey, CASE WHEN i = 0 THEN 'XIa' ELSE ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX'][i // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][i % 10 + 1] END AS numeral, CAST(nullif(i, 0) AS INTEGER) AS value FROM (SELECT p_partkey, p_partkey % 90 AS i FROM part)""",
    "markers": """WITH l AS (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(l_quantity AS INTEGER) % 26 AS c, (l_linenumber - 1) % 7 + 1 AS f FROM lineitem)
        SELECT l_orderkey, l_linenumber, ['(' || q || ')', '(' || chr(97 + c) || ')', q || '.1.', q || '.', '–', 'x)', '‘(ii)'][f] AS marker, ['num', CASE WHEN c IN (8, 21, 23) AND CAST(q AS INTEGER) % 2 = 1 THEN 'roman' ELSE 'letter' END, 'decimal', 'paragraph', 'dash', 'other', 'roman'][f] AS kind,
            [q, chr(97 + c), q || '.1', q, CAST(l_linenumber AS VARCHAR), 'x', 'ii'][f] AS number, ['num', 'letter', '', 'num', 'num', 'letter', 'roman'][f] AS item FROM l""",
    "names_and_ids": """WITH p AS (SELECT *, p_partkey % 5 + 1 AS f, ['/' || p_brand || '/' || p_partkey || '.PDF', p_partkey || '.htm', p_partkey || '.fmx', p_partkey || '.txt', p_partkey || ' of  ' || p_brand][f] AS path FROM part)
        SELECT path, ['pdf', 'html', 'fmx', NULL, NULL][f] AS format, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || w[2:]), ' ') AS label,
            CASE f WHEN 1 THEN '_' || replace(p_brand, '#', '_') || '_' || p_partkey || '.PDF' WHEN 5 THEN p_partkey || '_of_' || replace(p_brand, '#', '_') ELSE path END || '.json' AS file, p_partkey || '/2020' AS act, path || ':v-' || left(sha256(p_name), 16) AS version FROM p""",
    "correlations": """SELECT l_orderkey AS doc_id, 0 AS page_no, CAST(l_linenumber AS INTEGER) AS line_no, CASE l_linenumber % 4 WHEN 0 THEN 'Article ' ELSE 'Annex ' END || l_partkey AS repealed, CASE l_linenumber % 4 WHEN 0 THEN 'Articles ' || l_suppkey || ' and 9' END AS this_act FROM lineitem WHERE l_linenumber % 4 < 2""",
    "catalog_distinct": """SELECT 'roles' AS kind, '{"id": "r' || o_custkey || '", "label": "x"}' AS item, 'r' || o_custkey AS item_id, min(o_orderkey) AS first FROM orders GROUP BY o_custkey
        UNION ALL SELECT 'questions', '{"id": "' || o_orderpriority || '"}', o_orderpriority, min(o_orderkey) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'definitions', '{"termId": "d"}', 'd', min(o_orderkey) FROM orders HAVING count(*) > 0""",
    "unknown_topics": "SELECT DISTINCT 'kg:topic.' || replace(lower(p_brand), '#', '-') || '-' || p_size AS topic_id, replace(p_brand, '#', ' ') || ' ' || p_size AS label FROM part WHERE p_size % 4 = 3",
    "condition_eval": """WITH p AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
        SELECT CAST(c AS VARCHAR) AS assessment_id, CAST(p AS VARCHAR) AS rule_id, CASE WHEN c_nationkey * 2 < p_size THEN false WHEN p_brand = 'Brand#' || (c_nationkey + 1) THEN true END AS holds FROM p JOIN customer ON c = c_custkey JOIN part ON p = p_partkey""",
    "condition_leaves": """SELECT CAST(p_partkey AS VARCHAR) AS rule_id, CAST(i * 2 - 1 AS INTEGER) AS place, ['n', 'b', 'open'][i] AS q, ['gte', 'eq', 'is_true'][i] AS op, [CAST(p_size AS VARCHAR), '"' || p_brand || '"', NULL][i] AS value FROM part, (SELECT unnest([1, 2, 3]) AS i)""",
    "operator_matrix": """SELECT CAST(p_partkey AS VARCHAR) AS rule_id, 0 AS place, 's' || p_size AS q, ['gte', 'is_true', 'contains'][p_partkey % 3 + 1] AS op, ['number', 'boolean', 'multi_choice'][p_size % 3 + 1] AS answer_type FROM part WHERE p_partkey % 3 <> p_size % 3""",
    "question_cycles": "SELECT l_orderkey AS group_id, CAST(row_number() OVER (PARTITION BY l_orderkey) AS VARCHAR) AS q FROM lineitem WHERE l_orderkey % 3 = 0",
    "declared": """SELECT page_id AS doc_id, 'canonical address differs from the declared one' AS message FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'source title differs from the declared one' FROM pages WHERE page_id % 4 = 1""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE_SQL}
