"""Acts in layout text, parsed in one go; nodes, amendments and findings are held against what the rules give."""

from collections import defaultdict

import pytest

from folio.functions.text import layout_marker
from folio.operators import integrity, packages
from folio.sources import layout, layout_act
from pyspark.sql import functions as F

BODY = ("HAVE ADOPTED THIS REGULATION:", "CHAPTER I", "General", "Article 1", "Purpose")
ACTS = {
    "levels": ("Title", "  (1) First", "goes on.", "  (2) Second.", *BODY, "  1. Text", "wrapped.", "CHAPTER II", "Second", "Article 2", "Scope", "Whole text.", "Done at Brussels", "For the Council", "ANNEX I", "Goods", "of kinds", "Part A — Tools", "  1. Saws", "SECTION 3", "Class B", "Rest", "Article 9"),
    "outside": ("HAS ADOPTED THIS DECISION:", "SECTION 1", "Article 1", "One"),
    "formula": ("Article 1", "One"),
    "markers": (*BODY, "  1. One:", "     (a) a:", "        (i) first;", "        (ii) second;", "     (b) b:", "        — dash", "        — dash", "  (2) number:", "     (a) below it"),
    "decimals": ("HAVE ADOPTED THIS REGULATION:", "ANNEX I", "Title", "  1. GENERAL RULES", "  1.1. Lighting", "  1.1.1. The light shall shine.", "     (a) a;", "  1.2. Sound", "  (1) x"),
    "subparagraphs": (*BODY, "  1. One:", "     (a) a;", "     (b) b.", "", "  False break.", "     (c) c.", "", "     True one.", "  2. Two:", "     (a) x.", "", "         Indented to the item."),
    "romans": (*BODY, "  1. One:", "     (g) g;", "     (h) h:", "     (i) one;", "        (ii) two;", "  2. Two:", "     (i) one;", "        (ii) two;"),
    "amendments": ("HAVE ADOPTED THIS REGULATION:", "Article 1", "Amendments to Regulation (EU) No 12/2020", "  It is amended as follows:", "  (1) Article 5 is replaced by the following:", "‘Article 5", "  (a) quoted " + "x" * 400, "’;", "  (2) point IS.1 is amended:", "     (a) the heading is replaced by the following:", "‘New heading’;", "  (3) Articles 6 and 7 are deleted.", "Article 2", "Other", "  Text ends:", "‘thing’ means it"),
    "open": ("HAVE ADOPTED THIS REGULATION:", "ANNEX I", "Annex II to Directive 95/46/EC is amended as follows:", "  (1) point 3 is replaced by the following:", "‘never closed"),
    "tables": ("HAVE ADOPTED THIS REGULATION:", "Article 1", "Definitions", "  (1) ‘a’ means b;", "  1. x:", "     (1) no definition;", "ANNEX I", "Rules", "ORO.GEN.105 Authority", "ORO.GEN.110 Other", "ORO.GEN.105 Authority", "  (a) It acts.", "ANNEX II", "CORRELATION TABLE", "  Article 1     Article 2", "ANNEX III", "Entities", "Sector   Subsector   Type of entity", "  1. Energy"),
    "a": BODY,
    "b": BODY,
}


@pytest.fixture(scope="module")
def parse(spark):
    rows = [(k, "\n".join(v), k.upper()) for k, v in ACTS.items()] + [("none", None, "NONE"), ("empty", "", "EMPTY")]
    return layout_act.parse(spark.createDataFrame(rows, "doc_id string, text string, short_name string"))


def _by_act(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    return found


@pytest.fixture(scope="module")
def nodes(parse):
    """The nodes of each act by their ids without its name."""
    found = _by_act(parse.nodes().collect())
    return defaultdict(dict, {d: {r["node_id"].removeprefix(f"{d}:"): r for r in rows} for d, rows in found.items()})


@pytest.fixture(scope="module")
def findings(parse):
    return defaultdict(list, {d: [r["message"] for r in rows] for d, rows in _by_act(parse.findings().collect()).items()})


@pytest.fixture(scope="module")
def amendments(parse):
    return _by_act(parse.amendments().orderBy("doc_id", "seq").collect())


def test_levels_recitals_and_signature(nodes):
    found = nodes["levels"]
    assert found["preamble"]["text"] == "Title"
    assert (found["rec_1"]["text"], found["rec_1"]["is_normative"], found["rec_1"]["parent_id"]) == ("First goes on.", False, "levels:preamble")
    assert (found["art_1.par_1"]["text"], found["art_1.par_1"]["citation"]) == ("Text wrapped.", "LEVELS Art. 1(1)")
    assert (found["art_2"]["parent_id"], found["art_2"]["text"]) == ("levels:chap_II", "Whole text.")
    assert found["anx_I"]["heading"] == "Goods of kinds"
    assert (found["anx_I.part_A"]["heading"], found["anx_I.part_A.par_1"]["citation"]) == ("Tools", "LEVELS Annex I, Part A, point 1")
    # Lines of sections and articles open nothing in an annex: they are text.
    assert found["anx_I.part_A.par_1"]["text"] == "Saws SECTION 3"
    assert (found["anx_I.class_B"]["heading"], found["anx_I.class_B"]["text"]) == ("Rest", "Article 9")


def test_a_section_outside_of_chapters_and_a_missing_formula_are_errors(findings):
    assert findings["outside"] == ["Section 1 found outside any chapter"]
    assert findings["formula"][0].startswith("Enacting formula")


def test_markers_nest_by_the_stack(nodes):
    found = nodes["markers"]
    assert found["art_1.par_1.let_a.rom_ii"]["citation"] == "MARKERS Art. 1(1)(a)(ii)"
    assert found["art_1.par_1.let_b.das_dash2"]["parent_id"] == "markers:art_1.par_1.let_b"
    # A kind that is not open goes below what is; one that is ends what stands below it.
    assert found["art_1.par_1.let_b.das_dash2.num_2"]["citation"] == "MARKERS Art. 1(1)(b)(dash2)(2)"
    assert found["art_1.par_1.let_a~2"]["parent_id"] == "markers:art_1.par_1"


def test_decimals_by_depth_and_capital_titles_in_annexes(nodes):
    found = nodes["decimals"]
    assert found["anx_I.ach_1"]["heading"] == "GENERAL RULES"
    assert (found["anx_I.ach_1.dec_1_1"]["heading"], found["anx_I.ach_1.dec_1_1"]["text"]) == ("Lighting", "")
    assert found["anx_I.ach_1.dec_1_1.dec_1_1_1"]["citation"] == "DECIMALS Annex I, point 1.1.1"
    assert found["anx_I.ach_1.dec_1_2"]["parent_id"] == "decimals:anx_I.ach_1"


def test_subparagraphs_and_their_undoing(nodes, findings):
    found = nodes["subparagraphs"]
    assert found["art_1.par_1.let_b"]["text"] == "b. False break."
    assert (found["art_1.par_1.subpar_2"]["text"], found["art_1.par_1.subpar_2"]["citation"]) == ("True one.", "SUBPARAGRAPHS Art. 1(1), subparagraph 2")
    assert found["art_1.par_2.let_a.subpar_2"]["parent_id"] == "subparagraphs:art_1.par_2.let_a"
    assert findings["subparagraphs"] == ["False subparagraph undone after SUBPARAGRAPHS Art. 1(1)(b)"]


def test_roman_lists_read_as_letters_are_read_again(nodes):
    found = nodes["romans"]
    assert [(found[f"art_1.par_1.{p}"]["parent_id"], found[f"art_1.par_1.{p}"]["citation"]) for p in ("let_i", "let_i.rom_ii")] == [("romans:art_1.par_1.let_h", f"ROMANS Art. 1(1)(h)({k})") for k in ("i", "ii")]
    assert (found["art_1.par_2.let_i.rom_ii"]["parent_id"], found["art_1.par_2.let_i.rom_ii"]["citation"]) == ("romans:art_1.par_2", "ROMANS Art. 1(2)(ii)")


def test_quotations_and_amendments(spark, parse, nodes, amendments):
    assert not any("quoted" in r["text"] for r in nodes["amendments"].values()) and "art_5" not in nodes["amendments"]
    found = [(r["citation"], r["operation"], r["target_act"], r["target"], len(r["inserted_text"])) for r in amendments["amendments"]]
    assert found == [("AMENDMENTS Art. 1(1)", "replace", "12/2020", "5", 300), ("AMENDMENTS Art. 1(2)(a)", "replace_heading", "12/2020", "IS.1", 14), ("AMENDMENTS Art. 1(3)", "delete", "12/2020", "Articles 6 and 7", 0)]
    titles = spark.createDataFrame([("amendments", "12/2020"), ("amendments", "9/2021")], "doc_id string, act string")
    assert [r["act"] for r in integrity.unrecorded_amendments(titles, parse.amendments()).collect()] == ["9/2021"]


def test_an_open_quotation_is_an_error(nodes, findings, amendments):
    assert findings["open"] == ["Unclosed quotation at end of document"]
    assert (amendments["open"][0]["target_act"], nodes["open"]["anx_I"]["ptype"]) == ("95/46/EC", "amending_annex")


def test_contents_tables_and_definitions(parse, nodes, findings):
    found = nodes["tables"]
    assert found["art_1.num_1"]["ptype"] == "definition" and found["art_1.par_1.num_1"]["ptype"] == "point"
    assert found["anx_I.ORO.GEN.105.let_a"]["parent_id"] == "tables:anx_I.ORO.GEN.105" and "anx_I.ORO.GEN.105~2" not in found
    assert (found["anx_II"]["ptype"], found["anx_III"]["ptype"]) == ("correlation_annex", "table_annex")
    assert [r["line"] for r in parse.correlations().collect()] == ["Article 1     Article 2"]
    assert not findings["tables"]


def test_acts_do_not_mix_and_empty_ones_have_no_nodes(nodes):
    assert all(set(nodes[k]) == {"preamble", "chap_I", "art_1"} for k in "ab") and not nodes["none"] and not nodes["empty"]


@pytest.mark.parametrize("line, kind", [("  — x", "dash"), ("  – x", None), ("  - x", None), ("  (a) ", "letter"), ("  1. ", "paragraph"), ("  (xii) x", "roman"), ("  (xiii) x", None)])
def test_layout_markers(spark, line, kind):
    assert spark.createDataFrame([(line,)], "line string").select(layout_marker(F.col("line"))["kind"].alias("k")).first()["k"] == kind


@pytest.mark.parametrize("answer, json", [('{"a":1} see [2]', '{"a":1}'), ('{"a":1} then {"b":2}', '{"a":1}'), ('{"a":1} , x', None), ("{" * 5000, None)])
def test_recovered_objects(spark, answer, json):
    assert spark.createDataFrame([(answer,)], "a string").select(packages.recovered("a").alias("j")).first()["j"] == json


def test_footnote_calls_across_lines(spark):
    page = "It refers to point\n(1) of law and law (2) too.\n  (1) Regulation one\n"
    called = "It rests on law\n(1) and more.\n  (1) Regulation one\n"
    start = "(1) at the start.\n  (1) Regulation one\n"
    docs = spark.createDataFrame([(1, page), (2, called), (3, start)], "doc_id int, text string")
    assert [(r["doc_id"], r["cut"]) for r in layout.footnote_cuts(layout.lines(docs)).collect()] == [(2, 2)]


def test_lists_without_a_letter_i_are_not_read_again_and_texts_come_with_events(spark):
    """Events carry what they take of a line, so no line is joined to them; nodes without a letter (i) pass as they are."""
    lines = [(0, "HAVE ADOPTED THIS REGULATION:"), (1, "CHAPTER I"), (2, "Scope"), (3, "Article 1"), (4, "Aim"), (5, "  1. It shall:"), (6, "     (a) be read"), (7, "         once;")]
    frame = spark.createDataFrame([("d", 0, n, line) for n, line in lines], "doc_id string, page_no int, line_no int, line string")
    parse = layout_act.Parse(frame, F.upper("doc_id"))
    assert {r["piece"] for r in parse.events.where("event in ('text', 'heading')").collect()} == {"Scope", "Aim", "It shall:", "be read", "once;"}
    parse.lines = None
    rows = {r["node_id"]: (r["parent_id"], r["heading"], r["text"]) for r in parse.nodes().collect()}
    assert rows["d:art_1.par_1.let_a"] == ("d:art_1.par_1", "", "be read once;") and rows["d:art_1"] == ("d:chap_I", "Aim", "")


def test_nodes_are_made_in_one_pass_and_nothing_is_checkpointed(spark, monkeypatch):
    made = []
    monkeypatch.setattr(layout_act, "cut", lambda df: made.append(1) or df)
    rows = [(k, "\n".join(v), k.upper()) for k, v in ACTS.items() if k != "romans"]
    parse = layout_act.parse(spark.createDataFrame(rows, "doc_id string, text string, short_name string"))
    assert parse.nodes().count() > 60 and not made and "events" not in vars(parse)


def test_batches_of_a_line_give_the_same_nodes(spark, nodes):
    """Nodes leave the automaton once nothing more can be told of them, wherever batches end."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = [(k, "\n".join(v), k.upper()) for k, v in ACTS.items()]
        found = layout_act.parse(spark.createDataFrame(rows, "doc_id string, text string, short_name string")).nodes().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(map(repr, found)) == sorted(repr(r) for act in nodes.values() for r in act.values())


def test_columns_as_lists_keep_nulls_and_kinds():
    import pyarrow as pa

    for column in (pa.array([1, None, 2**60 + 1]), pa.array([2**60 + 1, -1]), pa.array([True, None]), pa.array(["a", None, ""]), pa.array([], pa.bool_())):
        got = layout_act._listed(column)
        assert got == column.to_pylist() and [type(x) for x in got] == [type(x) for x in column.to_pylist()]


def test_a_null_line_is_no_text(spark):
    frame = spark.createDataFrame([("d", 0, n, line) for n, line in enumerate(["HAVE ADOPTED THIS REGULATION:", "Article 1", "Aim", "  1. It", None, "goes on"])], "doc_id string, page_no int, line_no int, line string")
    rows = {r["node_id"]: r["text"] for r in layout_act.Parse(frame, F.upper("doc_id")).nodes().collect()}
    assert rows["d:art_1.par_1"] == "It goes on"
