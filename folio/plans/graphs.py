"""Queries over Turtle that is rendered from the tables, a small file a row, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology
from ..sources import turtle
from ..sources.tables import table

OWN = ("rk:", "https://example.org/o#")
_HEAD = f"@prefix rk: <{OWN[1]}> .\n@prefix rdfs: <{ontology.RDFS}> . @prefix owl: <{ontology.OWL}> .\nPREFIX skos: <{ontology.SKOS}>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n# rendered\n"
_SCHEMA = """rk:Region a owl:Class ; rk:lpgLabel "Region" . rk:Nation a owl:Class ; rk:lpgLabel "Nation" ; rk:storage "shared-kb" .
rk:Customer a owl:Class ; rk:lpgLabel "Customer" ; rk:storage "private" .
rk:within a owl:ObjectProperty ; rk:lpgRelationship "WITHIN" . rk:livesIn a owl:ObjectProperty ; rk:lpgRelationship "LIVES_IN" .
rk:segment a owl:DatatypeProperty ; rk:lpgProperty "segment" ."""


def _files(df: DataFrame, prefix: str, key: str, *pieces: Column | str) -> DataFrame:
    """(doc_id, content): a file a row; what is in braces in a piece of text is a column."""
    parts = []
    for piece in pieces:
        for i, part in enumerate(piece.replace("}", "{").split("{")):
            parts.append(F.col(part).cast("string") if i % 2 else F.lit(part))
    return df.select(F.concat(F.lit(prefix), key).alias("doc_id"), F.concat(F.lit(_HEAD), *parts).alias("content"))


def _read(*files: DataFrame) -> DataFrame:
    every = files[0]
    for more in files[1:]:
        every = every.union(more)
    return turtle.triples(turtle.read(every))


def turtle_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of a file for each part: names in two languages, numbers, a typed year, a node within a node with a list."""
    body = 'rk:p{p_partkey} a rk:{p_type} ; rdfs:label "{p_name}"@en , """{p_brand} "{p_name}\\""""@fr-BE ;\n  rk:size {p_size} , {p_size}.5 ; ; rk:price "{p_retailprice}"^^xsd:double ;\n  rk:made [ rk:from ( "{p_brand}" rk:{p_type} ) ; rk:checked true ] .'
    found = turtle.read(_files(table(spark, sf_dir, "part"), "p", "p_partkey", body))
    return found.select("doc_id", "seq", "s", "p", "o", "kind", "lang", F.replace("datatype", F.lit(turtle.XSD), F.lit("xsd:")).alias("datatype"), "error")


def turtle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with files of orders: a third each lacks an end, uses a prefix without a name, or is whole."""
    orders = table(spark, sf_dir, "orders").withColumn("_end", F.element_at(F.array(F.lit(""), F.lit(" .\nno:such rk:p 1 ."), F.lit(" .")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return turtle.findings(turtle.read(_files(orders, "o", "o_orderkey", "rk:o{o_orderkey} rk:by rk:c{o_custkey}{_end}")))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are classes, nations of a region below it, customers below their nations; a nation of an even key has a parent outside too."""
    regions = table(spark, sf_dir, "region").withColumn("r_name", F.replace("r_name", F.lit(" "), F.lit("_")))
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.withColumn("_even", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(', <http://www.w3.org/ns/prov#E'), "n_nationkey", F.lit('> ; rdfs:label "n"@en , "m"@fr'))).otherwise(F.lit(' ; rdfs:label "zwei"@de , "deux"@fr')))
    nations = nations.withColumn("_store", F.when(F.col("n_nationkey") % 3 == 0, ' ; rk:lpgLabel "L" ; rk:storage "private"').otherwise(' ; rk:storage "shared-kb"'))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _read(
        _files(regions, "r", "r_regionkey", "rk:{r_name} a owl:Class . <http://x#{r_name}> a owl:Class ."),
        _files(nations, "n", "n_nationkey", "rk:{n_name} a owl:Class ; rdfs:subClassOf rk:{r_name}{_even}{_store} ."),
        _files(customers, "c", "c_custkey", 'rk:c{c_custkey} a owl:Class ; rdfs:subClassOf rk:{n_name} ; skos:prefLabel "{c_mktsegment}"@en .'),
    )


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.class_tree(_classes(spark, sf_dir), OWN[1], OWN)


def property_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as properties from a type and a brand to a type of data; those of an odd size have a relationship, others a comment over two lines."""
    parts = table(spark, sf_dir, "part").withColumns({"_brand": F.replace("p_brand", F.lit("#"), F.lit("-")), "_more": F.when(F.col("p_size") % 2 == 1, F.concat(F.lit('rk:lpgRelationship "R'), "p_size", F.lit('"'))).otherwise(F.concat(F.lit('rdfs:comment "'), "p_name", F.lit('\\n|'), F.repeat(F.lit("x"), 200), F.lit('"@en')))})
    files = _files(parts, "p", "p_partkey", "rk:p{p_partkey} a owl:ObjectProperty ; rdfs:domain rk:{p_type} , rk:{_brand} ; rdfs:range xsd:date ; {_more} .")
    return ontology.property_table(_read(files), OWN, "ObjectProperty")


def concept_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are schemes of two kinds, those of every fifth have no concepts; customers are concepts of them by their segment, with notes."""
    nations = table(spark, sf_dir, "nation").withColumn("_kind", F.when(F.col("n_nationkey") % 2 == 0, "skos:ConceptScheme").otherwise("rk:ClassificationScheme"))
    customers = table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").withColumn("_note", F.element_at(F.array(F.lit(' ; skos:example "e" ; skos:definition "d"'), F.lit(' ; skos:definition "d" ; skos:scopeNote "s"'), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int")))
    files = [_files(nations, "n", "n_nationkey", "rk:N{n_nationkey} a {_kind} ."), _files(customers, "c", "c_custkey", 'rk:c{c_custkey} skos:inScheme rk:N{c_nationkey} ; skos:notation "{c_mktsegment}"{_note} .')]
    return ontology.schemes(_read(*files), OWN, [f"{ontology.SKOS}ConceptScheme", f"{OWN[1]}ClassificationScheme"])


def property_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, name, storage, n): vertices by label, edges by relationship, values by name, of regions, nations and customers. A link to what is no vertex is no edge."""
    schema = spark.range(1).select(F.lit("schema").alias("doc_id"), F.lit(_HEAD + _SCHEMA).alias("content"))
    triples = _read(
        schema,
        _files(table(spark, sf_dir, "region"), "r", "r_regionkey", "rk:r{r_regionkey} a rk:Region ; rk:within rk:World ."),
        _files(table(spark, sf_dir, "nation"), "n", "n_nationkey", "rk:n{n_nationkey} a rk:Nation ; rk:within rk:r{n_regionkey} ."),
        _files(table(spark, sf_dir, "customer"), "c", "c_custkey", 'rk:c{c_custkey} a rk:Customer ; rk:livesIn rk:n{c_nationkey} ; rk:segment "{c_mktsegment}" ; rk:unnamed 1 .'),
    )
    count, none = F.count("*").alias("n"), F.lit(None).cast("string").alias("storage")
    vertices = ontology.vertices(triples, OWN).groupBy("label", "storage").agg(count).select(F.lit("vertex").alias("part"), F.col("label").alias("name"), "storage", "n")
    edges = ontology.edges(triples, OWN).groupBy("relationship").agg(count).select(F.lit("edge"), "relationship", none, "n")
    values = ontology.vertex_properties(triples, OWN).groupBy("name").agg(count).select(F.lit("property"), "name", none, "n")
    return vertices.union(edges).union(values)


_O = OWN[1]
_RDF, _RDFS = ontology.RDF, ontology.RDFS
ORACLE_SQL: dict[str, str] = {
    "turtle_triples": f"""WITH t AS (SELECT 'p' || p_partkey AS doc_id, '{_O}p' || p_partkey AS me, '_:[1]@p' || p_partkey AS made, '_:[2]@p' || p_partkey AS c1, '_:[3]@p' || p_partkey AS c2, '{_O}' || p_type AS typ, * FROM part),
        w AS (SELECT doc_id, unnest([
            {{'seq': 0, 's': me, 'p': '{_RDF}type', 'o': typ, 'kind': 'iri', 'lang': NULL, 'datatype': NULL}},
            {{'seq': 1, 's': me, 'p': '{_RDFS}label', 'o': p_name, 'kind': 'literal', 'lang': 'en', 'datatype': '{_RDF}langString'}},
            {{'seq': 2, 's': me, 'p': '{_RDFS}label', 'o': p_brand || ' "' || p_name || '"', 'kind': 'literal', 'lang': 'fr-be', 'datatype': '{_RDF}langString'}},
            {{'seq': 3, 's': me, 'p': '{_O}size', 'o': CAST(p_size AS VARCHAR), 'kind': 'literal', 'lang': NULL, 'datatype': 'xsd:integer'}},
            {{'seq': 4, 's': me, 'p': '{_O}size', 'o': p_size || '.5', 'kind': 'literal', 'lang': NULL, 'datatype': 'xsd:decimal'}},
            {{'seq': 5, 's': me, 'p': '{_O}price', 'o': CAST(p_retailprice AS VARCHAR), 'kind': 'literal', 'lang': NULL, 'datatype': 'xsd:double'}},
            {{'seq': 6, 's': c1, 'p': '{_RDF}first', 'o': p_brand, 'kind': 'literal', 'lang': NULL, 'datatype': 'xsd:string'}},
            {{'seq': 7, 's': c1, 'p': '{_RDF}rest', 'o': c2, 'kind': 'blank', 'lang': NULL, 'datatype': NULL}},
            {{'seq': 8, 's': c2, 'p': '{_RDF}first', 'o': typ, 'kind': 'iri', 'lang': NULL, 'datatype': NULL}},
            {{'seq': 9, 's': c2, 'p': '{_RDF}rest', 'o': '{_RDF}nil', 'kind': 'iri', 'lang': NULL, 'datatype': NULL}},
            {{'seq': 10, 's': made, 'p': '{_O}from', 'o': c1, 'kind': 'blank', 'lang': NULL, 'datatype': NULL}},
            {{'seq': 11, 's': made, 'p': '{_O}checked', 'o': 'true', 'kind': 'literal', 'lang': NULL, 'datatype': 'xsd:boolean'}},
            {{'seq': 12, 's': me, 'p': '{_O}made', 'o': made, 'kind': 'blank', 'lang': NULL, 'datatype': NULL}}]) AS r FROM t)
        SELECT doc_id, unnest(r), CAST(NULL AS VARCHAR) AS error FROM w""",
    "turtle_findings": "SELECT 'o' || o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'line 6: the text ends within a statement' ELSE 'line 7: unknown prefix ''no''' END AS message FROM orders WHERE o_orderkey % 3 < 2",
    "class_tree": """WITH g AS (SELECT r_regionkey, replace(r_name, ' ', '_') AS r_name FROM region), n AS (SELECT *, 'rk:' || r_name || ' > rk:' || n_name AS place FROM nation JOIN g ON n_regionkey = r_regionkey)
        SELECT 'rk:' || r_name AS place, 0 AS depth, 'rk:' || r_name AS name, '' AS label, CAST(NULL AS VARCHAR) AS node_label, false AS private, '' AS outside FROM g
        UNION ALL SELECT place, 1, 'rk:' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'n' ELSE 'deux' END, CASE WHEN n_nationkey % 3 = 0 THEN 'L' END, n_nationkey % 3 = 0, CASE WHEN n_nationkey % 2 = 0 THEN 'prov:E' || n_nationkey ELSE '' END FROM n
        UNION ALL SELECT place || ' > rk:c' || c_custkey, 2, 'rk:c' || c_custkey, c_mktsegment, NULL, false, '' FROM customer JOIN n ON c_nationkey = n_nationkey""",
    "property_tables": """SELECT 'rk:p' || p_partkey AS name, CASE WHEN replace(p_brand, '#', '-') < p_type THEN 'rk:' || replace(p_brand, '#', '-') || ', rk:' || p_type ELSE 'rk:' || p_type || ', rk:' || replace(p_brand, '#', '-') END AS domains, 'xsd:date' AS ranges,
        CASE WHEN p_size % 2 = 1 THEN 'R' || p_size ELSE '' END AS relationship, CASE WHEN p_size % 2 = 1 THEN '' ELSE left(p_name || ' /' || repeat('x', 200), 160) END AS comment FROM part""",
    "concept_schemes": """WITH c AS (SELECT 'rk:N' || n_nationkey AS scheme, 'rk:c' || c_custkey AS concept, coalesce(c_mktsegment, '') AS notation, '' AS label, CASE c_custkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 's' ELSE '' END AS note FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0)
        SELECT *, CAST(row_number() OVER (PARTITION BY scheme ORDER BY notation, concept) AS INTEGER) AS rank FROM c""",
    "property_graph": """SELECT 'vertex' AS part, 'Region' AS name, CAST(NULL AS VARCHAR) AS storage, count(*) AS n FROM region UNION ALL SELECT 'vertex', 'Nation', 'shared-kb', count(*) FROM nation UNION ALL SELECT 'vertex', 'Customer', 'private', count(*) FROM customer
        UNION ALL SELECT 'edge', 'WITHIN', NULL, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'edge', 'LIVES_IN', NULL, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'property', 'segment', NULL, count(*) FROM customer""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE_SQL}
