"""Reports and JSON texts of small documents: nulls, documents without nodes, texts that are none."""

import json

from folio.operators import integrity, schemas
from folio.sources import parsed

_NODES = "doc_id string, node_id string, seq long, ptype string, local_id string, citation string, parent_id string, heading string, text string, is_normative boolean, marker string, ordinal int"


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, _NODES)


ROWS = [("x", "x:1", 0, "article", "1", "X Art. 1", None, None, 'sa"y\n', True, None, None), ("x", "x:1.a", 1, "point", "a", "X Art. 1(a)", "x:1", "", "", None, "letter", 0), ("x", "x:1.c", 2, "point", "c", "X Art. 1(c)", "x:1", "", "ü", True, "letter", 1),
        ("x", "x:3", 3, "article", "3", "X Art. 3", None, "H", None, True, "", None), ("x", "x:3.2", 4, "paragraph", "2", "X Art. 3(2)", "x:3", "", "", True, "paragraph", 0), ("x", "x:3.b", 5, "point", "b", "X Art. 3(b)", "x:3", "", "", True, "letter", 1), ("y", "y:r", 0, "recital", "2", "Y Rec. 2", None, "", "", False, "", None)]


def test_reports(spark):
    errors = spark.createDataFrame([("y", 2, "late"), ("y", 1, "early"), ("z", 0, "torn")], "doc_id string, place int, message string")
    got = {r["doc_id"]: r.asDict() for r in integrity.report(nodes_of(spark, ROWS), errors).collect()}
    assert set(got) == {"x", "y", "z"}
    assert got["x"]["sequence_errors"] == ["X Art. 1: letters (a)(c)", "X Art. 3: letters (b)", "X Art. 3: paragraphs [2]"]
    assert (got["x"]["articles_found"], got["x"]["article_gaps"], got["x"]["errors"], got["x"]["articles_without_heading"]) == (2, [2], [], ["X Art. 1"])
    assert (got["y"]["recitals_found"], got["y"]["recital_gaps"], got["y"]["errors"]) == (1, [1], ["early", "late", "No articles found"])
    assert (got["z"]["errors"], got["z"]["articles_found"], got["z"]["sequence_errors"]) == (["torn", "No articles found"], 0, [])
    assert integrity.report(nodes_of(spark, []), errors.limit(0)).count() == 0


def test_texts_and_back(spark, tmp_path):
    heads = spark.createDataFrame([("x",), ("y",), ("empty",)], "doc_id string").selectExpr("doc_id", "named_struct('id', doc_id, 'title', 'Ü') as document")
    texts = parsed.rendered(heads, nodes_of(spark, ROWS), integrity.report(nodes_of(spark, ROWS), spark.createDataFrame([], "doc_id string, place int, message string")))
    parsed.saved(texts, str(tmp_path / "out"))
    read = parsed.stored(spark, str(tmp_path / "out"))
    whole = {r["doc_id"]: json.loads(r["json"]) for r in read.collect()}
    assert [n["id"] for n in whole["x"]["nodes"]] == ["x:1", "x:1.a", "x:1.c", "x:3", "x:3.2", "x:3.b"] and whole["x"]["nodes"][0]["children"] == ["x:1.a", "x:1.c"]
    assert whole["x"]["nodes"][0]["text"] == 'sa"y\n' and whole["x"]["nodes"][0]["parent"] is None and whole["empty"]["nodes"] == [] and whole["empty"]["document"]["title"] == "Ü"
    want = {(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7] or "", r[8] or "", bool(r[9]), r[10] or "", r[11]) for r in ROWS}
    assert {tuple(r) for r in parsed.nodes(read).collect()} == want
    assert {r["path"].split(".")[0] for r in schemas.broken_documents(read.selectExpr("doc_id as key", "json")).collect()} == {"document"}


def test_what_cannot_be_read(spark):
    odd = spark.createDataFrame([("a", "[]"), ("b", '{"document": 1}'), ("c", None), ("d", "{"), ("e", '{"document": {}}')], "doc_id string, json string")
    assert {r["doc_id"] for r in parsed.unreadable(odd).collect()} == set("abcd")
    assert parsed.nodes(odd).count() == 0


def test_gaps_as_runs_are_the_gaps(spark):
    numbers = {"a": [3, 4, 9], "b": [1, 2], "c": [0], "d": [7], "e": ["x"], "f": [900_000]}
    nodes = nodes_of(spark, [(d, f"{d}:{n}", i, "article", str(n), f"{d} {n}", None, "h", "", True, "", None) for d, ns in numbers.items() for i, n in enumerate(ns)])
    listed = {r["doc_id"]: r["gaps"] for r in integrity.kind_gaps(nodes).collect()}
    runs = {r["doc_id"]: r["gaps"] or [] for r in integrity.kind_gaps(nodes, runs=True).collect()}
    assert {d: [n for first, last in found for n in range(first, last + 1)] for d, found in runs.items()} == listed
    whole = {r["doc_id"]: r["article_gaps"] for r in integrity.report(nodes, spark.createDataFrame([], "doc_id string, place int, message string"), runs=True).collect()}
    assert [tuple(r) for r in whole["f"]] == [(1, 899_999)] and whole["e"] == []


def test_sound_values_stay_in_the_reader(spark):
    told = {place: schemas._sound(rule) for place, rule in schemas.DOCUMENT.items()}
    node = {"id": "x", "ptype": "point", "local_id": "1", "citation": "c", "parent": None, "text": "", "is_normative": True, "children": []}
    text = json.dumps({"nodes": [node, node | {"ptype": "line"}, {k: v for k, v in node.items() if k != "text"}], "document": {"id": "kg:x"}, "report": []})
    rows = [(r["place"], r["kind"]) for r in schemas.json_values(spark.createDataFrame([("k", text)], "key string, json string"), [], told, ()).collect()]
    assert sorted(rows) == [("$.document", "object"), ("$.document.id", "string"), ("$.nodes[]", "object"), ("$.nodes[].ptype", "string"), ("$.report", "array")]


def test_acts_are_read_once(spark):
    from folio.plans import acts, checks

    for query in (acts.sequence_errors, checks.parse_report, checks.parsed_round_trip):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan or query is not checks.parsed_round_trip
        assert "lineitem" not in plan and "l_orderkey" not in plan


def test_nodes_of_a_text_meet_once(spark):
    """Texts are sent once, by document, and no node is joined to where its parent lists it; ids that repeat or are missing keep what they had."""
    node = {"id": "a", "ptype": "point", "local_id": "1", "citation": "c", "parent": None, "text": "", "is_normative": True, "children": ["b", "c", "b", None]}
    nodes = [node, node | {"id": "b", "parent": "a", "children": []}, node | {"id": "b", "parent": "a", "children": None}, node | {"id": None, "parent": "a", "children": ["x"]}, node | {"id": "x", "parent": None, "children": []}, node | {"id": "d", "parent": "a", "children": []}]
    texts = spark.createDataFrame([("k", json.dumps({"nodes": nodes})), (None, json.dumps({"nodes": nodes[:2]})), ("e", '{"nodes": []}')], "doc_id string, json string")
    found = parsed.nodes(texts)
    assert sorted((repr(r["doc_id"]), r["seq"], r["node_id"], r["ordinal"]) for r in found.collect()) == [("'k'", 0, "a", None), ("'k'", 1, "b", 0), ("'k'", 2, "b", 0), ("'k'", 3, None, None), ("'k'", 4, "x", None), ("'k'", 5, "d", None), ("None", 0, "a", None), ("None", 1, "b", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_table_keeps_no_shuffle_files(spark):
    from folio.functions import lineage

    key = lineage._CLEANED
    spark.conf.set(key, "false")
    table = lineage.cut(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count())
    assert spark.conf.get(key) == "false" and sorted(r["count"] for r in table.collect()) == [142] + [143] * 6
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString() and "parquet" in table._jdf.queryExecution().analyzed().toString()
