"""Turtle and the reports on it, over the tables and over small texts."""

import duckdb
import pytest

from folio.operators import ontology
from folio.plans import graphs
from folio.sources import turtle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(graphs.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer orders part".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = graphs.QUERIES[name](spark, SF)
    found = con.execute(graphs.ORACLE_SQL[name])
    columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(df.columns) and want
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))


def _read(spark, *texts):
    files = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "doc_id string, content string, error string")
    rows = sorted(turtle.read(files).collect(), key=lambda r: (r["doc_id"], r["seq"] or 0))
    return [[r for r in rows if r["doc_id"] == str(i)] for i in range(len(texts))]


def test_forms_of_terms(spark):
    text = """@base <http://b/x/> . @prefix : <http://d#> . @prefix e.f: <http://g/> .
<rel> a :C ; :p "x"@EN-gb, 'y\\n\\u0041' , '''a''b''', "" ; :n 3 , -1.5, 1e3, false ; .  # end
[ :only <#f> ] . [] :q () . _:z :l\\,x _:z . e.f:a.b :d e.f: . <> <#> </y> ."""
    (found,) = _read(spark, text)
    assert all(r["error"] is None for r in found) and [r["seq"] for r in found] == list(range(len(found)))
    assert [(r["s"], r["p"].replace(turtle.RDF, "rdf:"), r["o"].replace(turtle.RDF, "rdf:"), r["kind"], r["lang"]) for r in found] == [
        ("http://b/x/rel", "rdf:type", "http://d#C", "iri", None), ("http://b/x/rel", "http://d#p", "x", "literal", "en-gb"), ("http://b/x/rel", "http://d#p", "y\nA", "literal", None),
        ("http://b/x/rel", "http://d#p", "a''b", "literal", None), ("http://b/x/rel", "http://d#p", "", "literal", None),
        *(("http://b/x/rel", "http://d#n", n, "literal", None) for n in ("3", "-1.5", "1e3", "false")),
        ("_:[1]@0", "http://d#only", "http://b/x/#f", "iri", None), ("_:[2]@0", "http://d#q", "rdf:nil", "iri", None), ("_:z@0", "http://d#l,x", "_:z@0", "blank", None), ("http://g/a.b", "http://d#d", "http://g/", "iri", None), ("http://b/x/", "http://b/x/#", "http://b/y", "iri", None),
    ]
    assert [r["datatype"].rpartition("#")[2] for r in found if r["p"] == "http://d#n"] == ["integer", "decimal", "double", "boolean"]


def test_malformed_texts_are_findings_without_triples(spark):
    broken = ["<a> <b> <c> . <d>", "a:b <c> <d> .", '"s" <b> <c> .', '<a> "p" <c> .', "<a> <b> ( <c> .", "<a> <b> <c> ] .", '<a> <b> "\\q" .', "[ ] .", "<a> <b> a .", '<a> <b> "\\UFFFFFFFF" .', "@prefix x <a> .", "<a> <b> 1 <c> .", '<a> <b> "open']
    for rows in _read(spark, *broken):
        assert len(rows) == 1 and rows[0]["error"].startswith("line 1: ") and rows[0]["s"] is None


def test_empty_deep_and_long_texts(spark):
    deep = "<a> <b> " + "[ <c> " * 3000 + '"' + "long " * 100000 + '"' + " ]" * 3000 + " ."
    empty, none, comment, nested = _read(spark, "", None, "# only", deep)
    assert not empty and not none and not comment and len(nested) == 3001
    assert turtle.triples(turtle.read(spark.createDataFrame([], "doc_id string, content string"))).count() == 0


def test_repeated_triples_and_blank_nodes_of_files(spark):
    files = spark.createDataFrame([("x", "<a> <b> _:c , _:c ."), ("y", "<a> <b> _:c ."), ("z", "<a>")], "doc_id string, content string")
    found = turtle.read(files)
    assert {r["o"] for r in turtle.triples(found).collect()} == {"_:c@x", "_:c@y"} and found.where("error is null").count() == 3
    assert [tuple(r) for r in turtle.findings(found).collect()] == [("z", "line 1: the text ends within a statement")]


def test_vertices_of_two_classes_and_links_to_none(spark):
    text = '@prefix : <http://o#> . :A :lpgLabel "A" . :B :lpgLabel "B" ; :storage "private" . :r :lpgRelationship "R" . :x a :A , :B ; :r :y , :gone , :x . :y a :A . :z a :C .'
    graph = turtle.triples(turtle.read(spark.createDataFrame([("d", text)], "doc_id string, content string")))
    own = (":", "http://o#")
    assert {tuple(r) for r in ontology.vertices(graph, own).collect()} == {("http://o#x", "A", None), ("http://o#x", "B", "private"), ("http://o#y", "A", None)}
    assert {(r["start"][-1], r["end"][-1]) for r in ontology.edges(graph, own).collect()} == {("x", "y"), ("x", "x")}


def test_files_of_one_scan_are_read_by_many_tasks_in_few_batches(spark):
    files = spark.range(0, 20000, numPartitions=1).selectExpr("concat('d', id) as doc_id", "concat('<s> <p> ', id, if(id % 2 = 0, ' .', '')) as content")
    found = turtle.read(files)
    assert found.rdd.getNumPartitions() >= 12
    assert found.where("error is null").count() == found.where("error is not null").count() == 10000
