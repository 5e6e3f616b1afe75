"""Tables of entities from words at places; small pages, each word as (top, x0, text)."""

import duckdb
import pytest

from folio.plans import layouts
from folio.sources import entity_tables

SF = "/root/testdata/sf0.001"
HEAD = [(5, 10, "ANNEX"), (5, 40, "I"), (20, 100, "Subsector"), (20, 200, "Type")]
RULES = [8, 95, 195, 290]


def test_same_as_sql(spark):
    con = duckdb.connect()
    for table in "orders lineitem".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = layouts.QUERIES["entity_tables"](spark, SF)
    found = con.execute(layouts.ORACLE_SQL["entity_tables"])
    columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(df.columns) and len({r[2] for r in want}) == 3
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))


def _rows(spark, pages, rules=None):
    """What is read, as (kind, number, name), of pages by their numbers."""
    words = [("d", p, i, float(x), float(top), top + 10.0, text, "clash") for p, ws in pages.items() for i, (top, x, text) in enumerate(ws)]
    frame = spark.createDataFrame(words, "doc_id string, page_no int, seq int, x0 double, top double, bottom double, text string, annex string")
    ruled = spark.createDataFrame([("d", p, float(x)) for p in pages for x in (RULES if rules is None else rules)], "doc_id string, page_no int, x0 double")
    sizes = spark.createDataFrame([("d", p, 600.0) for p in pages], "doc_id string, page_no int, width double")
    found = entity_tables.entity_rows(entity_tables.table_lines(frame, ruled, sizes)).collect()
    return [(r["annex"], r["kind"], r["number"], r["name"]) for r in sorted(found, key=lambda r: (r["annex"], r["sector_at"], r["sub_at"], r["ent_at"]))]


def test_carry_over_pages_and_continued_texts(spark):
    pages = {1: [*HEAD, (40, 10, "before"), (40, 200, "lost"), (50, 10, "1."), (50, 30, "Energy"), (60, 100, "(a)"), (60, 120, "Power"), (60, 200, "first"), (70, 200, "goes"), (70.2, 230, "on")], 3: [(10, 100, "lines"), (10, 200, "—"), (10, 210, "second"), (20, 10, "and"), (30, 10, "2."), (40, 200, "—"), (50, 100, "(b)"), (50, 200, "x")]}
    assert _rows(spark, pages) == [("I", "sector", "1", "Energy and"), ("I", "subsector", "a", "Power lines"), ("I", "entity_type", "1", "first goes on"), ("I", "entity_type", "2", "second"), ("I", "sector", "2", ""), ("I", "entity_type", "1", ""), ("I", "subsector", "b", ""), ("I", "entity_type", "1", "x")]


def test_footnotes_other_annexes_and_a_new_start(spark):
    table = [(50, 10, "1."), (50, 30, "Old"), (50, 200, "—"), (50, 210, "e"), (60, 10, "(1)"), (70, 200, "note")]
    other = [(5, 10, "ANNEX"), (5, 40, "II"), (50, 10, "9."), (50, 200, "—")]
    again = [*HEAD, (50, 10, "1."), (50, 30, "New"), (50, 570, "EN"), (50, 580, "kept")]
    assert _rows(spark, {1: HEAD + table, 2: other, 3: table}) == [("I", "sector", "1", "Old"), ("I", "entity_type", "1", "e")]
    assert _rows(spark, {1: HEAD + table, 2: again}) == [("I", "sector", "1", "New"), ("I", "entity_type", "1", "kept")]


def test_columns_by_markers_and_near_rules(spark):
    page = [*HEAD, (50, 10, "1."), (50, 60, "Name"), (50, 200, "—"), (50, 210, "e"), (60, 150, "(a)"), (60, 160, "sub"), (60, 200, "f")]
    want = [("I", "sector", "1", "Name"), ("I", "entity_type", "1", "e"), ("I", "subsector", "a", "sub"), ("I", "entity_type", "1", "f")]
    assert _rows(spark, {1: page}, []) == want and _rows(spark, {1: page}, [8, 10, 11, 590]) == want
    assert _rows(spark, {1: page}, [8, 11, 14.5, 145, 147, 195])[0] == ("I", "sector", "1", "")  # rules at 8, 14.5, 145: names begin in the third column
    assert _rows(spark, {1: [*HEAD, (50, 10, "1."), (50, 60, "no marker")]}, []) == []


@pytest.mark.parametrize("pages", [{}, {1: [(50, 10, "1."), (50, 200, "—")]}])
def test_nothing_without_a_table(spark, pages):
    assert _rows(spark, pages) == []


def test_repeated_ids_and_annexes(spark):
    page = [*HEAD, *((50 + 30 * i, 10, "1.") for i in range(2)), *((60 + 30 * i + 10 * j, x, t) for i in range(2) for j in range(2) for x, t in ((100, "(a)"), (200, "—"), (210, "sec­"), (220, "tor")))]
    frame = spark.createDataFrame([("d", 1, i, float(x), float(t), t + 10.0, w) for i, (t, x, w) in enumerate(page)] + [("d", None, 1, None, 1.0, 1.0, None)], "doc_id string, page_no int, seq int, x0 double, top double, bottom double, text string")
    ruled = spark.createDataFrame([("d", 1, float(x)) for x in RULES], "doc_id string, page_no int, x0 double")
    sizes = spark.createDataFrame([("d", 1, 600.0)], "doc_id string, page_no int, width double")
    parsed = spark.createDataFrame([("d", "x:anx_I", "annex", "X Annex I"), ("d", "x:anx_II", "table_annex", "X Annex II"), ("e", "y:anx_I", "annex", "Y Annex I")], "doc_id string, node_id string, ptype string, citation string")
    rows = entity_tables.nodes(frame, ruled, sizes, parsed).orderBy("place").collect()
    assert [r["node_id"] for r in rows if r["ptype"] != "entity_type"] == ["x:anx_I.sec_1", "x:anx_I.sec_1.sub_a", "x:anx_I.sec_1.sub_a~2", "x:anx_I.sec_1~2", "x:anx_I.sec_1~2.sub_a", "x:anx_I.sec_1~2.sub_a~2"]
    assert {(r["citation"], r["text"]) for r in rows if r["ptype"] == "entity_type"} == {("X Annex I, point 1(a), entity 1", "sector")}


def test_words_are_sent_once_and_not_written(spark):
    plan = layouts.QUERIES["entity_tables"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("Final Plan")[-1]
    assert "ExistingRDD" not in tree  # nothing is checkpointed
    assert "REPARTITION_BY_NUM" in tree and tree.count("Exchange hashpartitioning(doc_id") <= 3 and "page_no" not in "".join(line for line in tree.splitlines() if "Exchange hashpartitioning" in line)


def test_words_above_the_head_and_pages_without_width(spark):
    page = [*HEAD, (8, 200, "—"), (50, 10, "1."), (50, 60, "Name"), (50, 210, "—"), (50, 220, "e")]
    # The dash above the head of the table tells no column.
    assert _rows(spark, {1: page}, []) == [("I", "sector", "1", "Name"), ("I", "entity_type", "1", "e")]
    words = spark.createDataFrame([("d", 1, i, float(x), float(t), t + 10.0, w) for i, (t, x, w) in enumerate(page)], "doc_id string, page_no int, seq int, x0 double, top double, bottom double, text string")
    none = spark.createDataFrame([], "doc_id string, page_no int, x0 double, width double")
    assert entity_tables.table_lines(words, none, none).count() == 0
