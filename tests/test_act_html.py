import html

from folio.sources import act_html


def row(mark, content):
    return f"<tr><td></td><td><p class='oj-normal'>{mark}</p></td><td>{content}</td></tr>"


def p(text, kind="oj-normal"):
    return f"<p class='{kind}'>{text}</p>"


ROMANS = "<table>" + row("(h)", p("eighth")) + row("(i)", p("ninth") + "<table><tbody>" + row("(i)", p("deep")) + row("(ii)", p("deeper")) + "</tbody></table>") + row("—", p("dash")) + "</table>"
PAGE = f"""<html><head><title>T</title></head><body>
<div id="rct_1"><table><tr><td>(1)</td><td>First <a class="oj-note-tag">7</a> reason.</td></tr></table></div><div id="rct_2">(2) Second reason.</div>
<div class="eli-subdivision" id="cpt_I"><p>CHAPTER I</p><div class="eli-title"><p>General</p></div>
 <div class="eli-subdivision" id="cpt_I.sct_1"><div class="eli-title"><p>Terms</p></div>
  <div id="art_2"><div class="eli-title"><p>Definitions</p></div>{p("Terms:")}<table>{row("(1)", p("‘a’ means b"))}{row("(a)", p("no term"))}</table>{p("They hold.")}<table>{row("(2)", p("late"))}</table></div></div>
 <div id="art_1"><div class="eli-title"><p>Scope</p></div><div id="001.001">{p("1. One.")}{ROMANS}</div><div id="001.002">{p("2. Two")}<div>{p("goes on")}<div id="009.001">{p("1. quoted")}</div></div></div></div>
 <div id="art_1"><div id="001.001">{p("1. Again.")}</div></div></div>
<div class="eli-container" id="anx_II">{p("ANNEX II", "oj-doc-ti")}{p("Things", "oj-doc-ti")}{p("Head")}{p("Part I", "oj-ti-grseq-1")}{p("First part", "oj-ti-grseq-1")}<table>{row("1.", p("one") + "<table>" + row("1.2.", p("dec") + "<table>" + row("(b)", p("leaf")) + "</table>") + "</table>")}{row("odd one", "<span>bare</span>")}</table>
 {p("3. Group of things", "oj-ti-grseq-1")}<div class="oj-enumeration-spacing"><p>1.1. Counted</p></div>{p("a note", "oj-note")}</div>
<div class="eli-container" id="anx_III">{p("ANNEX III", "oj-doc-ti")}{p("Correlation table", "oj-doc-ti")}<table>{row("1.", p("row"))}</table></div></body></html>"""
WANT = [
    ("x:preamble", "preamble", "X Preamble", None, ""),
    ("x:rec_1", "recital", "X Recital (1)", "x:preamble", "First reason."),
    ("x:rec_2", "recital", "X Recital (2)", "x:preamble", "Second reason."),
    ("x:chap_I", "chapter", "X Chapter I", None, ""),
    ("x:chap_I.sec_1", "section", "X Chapter I Section 1", "x:chap_I", ""),
    ("x:art_2", "article", "X Art. 2", "x:chap_I.sec_1", "Terms:"),
    ("x:art_2.num_1", "definition", "X Art. 2(1)", "x:art_2", "‘a’ means b"),
    ("x:art_2.let_a", "point", "X Art. 2(a)", "x:art_2", "no term"),
    ("x:art_2.subpar_2", "subparagraph", "X Art. 2, subparagraph 2", "x:art_2", "They hold."),
    ("x:art_2.subpar_2.num_2", "point", "X Art. 2, subparagraph 2(2)", "x:art_2.subpar_2", "late"),
    ("x:art_1", "article", "X Art. 1", "x:chap_I", ""),
    ("x:art_1.par_1", "paragraph", "X Art. 1(1)", "x:art_1", "One."),
    ("x:art_1.par_1.let_h", "point", "X Art. 1(1)(h)", "x:art_1.par_1", "eighth"),
    ("x:art_1.par_1.let_i", "point", "X Art. 1(1)(i)", "x:art_1.par_1", "ninth"),
    ("x:art_1.par_1.let_i.rom_i", "point", "X Art. 1(1)(i)(i)", "x:art_1.par_1.let_i", "deep"),
    ("x:art_1.par_1.let_i.rom_ii", "point", "X Art. 1(1)(i)(ii)", "x:art_1.par_1.let_i", "deeper"),
    ("x:art_1.par_1.das_dash1", "point", "X Art. 1(1)(dash1)", "x:art_1.par_1", "dash"),
    ("x:art_1.par_2", "paragraph", "X Art. 1(2)", "x:art_1", "Two goes on 1. quoted"),
    ("x:art_1~2", "article", "X Art. 1", "x:chap_I", ""),
    ("x:art_1.par_1~2", "paragraph", "X Art. 1(1)", "x:art_1~2", "Again."),
    ("x:anx_II", "annex", "X Annex II", None, "Head"),
    ("x:anx_II.part_I", "part", "X Annex II, Part I", "x:anx_II", ""),
    ("x:anx_II.part_I.par_1", "paragraph", "X Annex II, Part I, point 1", "x:anx_II.part_I", "one"),
    ("x:anx_II.part_I.par_1.dec_1_2", "point", "X Annex II, Part I, point 1.2", "x:anx_II.part_I.par_1", "dec"),
    ("x:anx_II.part_I.par_1.dec_1_2.let_b", "point", "X Annex II, Part I, point 1.2(b)", "x:anx_II.part_I.par_1.dec_1_2", "leaf"),
    ("x:anx_II.part_I.oth_odd_one", "point", "X Annex II, Part I(odd_one)", "x:anx_II.part_I", "bare"),
    ("x:anx_II.part_I.par_3", "paragraph", "X Annex II, Part I, point 3", "x:anx_II.part_I", ""),
    ("x:anx_II.part_I.par_3.dec_1_1", "point", "X Annex II, Part I, point 1.1", "x:anx_II.part_I.par_3", "Counted"),
    ("x:anx_III", "correlation_annex", "X Annex III", None, ""),
    ("x:anx_III.par_1", "paragraph", "X Annex III(1)", "x:anx_III", "row"),
]


def test_nodes_findings_and_views_of_the_source(spark):
    view = "<table class='source-container'>" + "".join(f"<tr><td class=line-number>1</td><td class='line-content'>{html.escape(line)}</td></tr>" for line in PAGE.split("\n")) + "</table>"
    files = spark.createDataFrame([("d", "X", PAGE.encode()), ("v", "X", view.encode()), ("null", "N", None), ("empty", "N", b""), ("odd", "N", b"\xff<p>text<div id='art_1'>")], "doc_id string, short_name string, content binary")
    found = act_html.blocks(files)
    nodes = act_html.act_nodes(files, found)
    rows = sorted(nodes.collect(), key=lambda r: (r["doc_id"], r["seq"]))
    for doc in "dv":
        assert [(r["node_id"], r["ptype"], r["citation"], r["parent_id"], r["text"]) for r in rows if r["doc_id"] == doc] == WANT
    assert [(r["doc_id"], r["node_id"]) for r in rows if r["doc_id"] not in "dv"] == [(d, "n:preamble") for d in ("empty", "null", "odd")]
    headings = {r["node_id"]: r["heading"] for r in rows if r["doc_id"] == "d" and r["heading"]}
    assert headings == {"x:chap_I": "General", "x:chap_I.sec_1": "Terms", "x:art_2": "Definitions", "x:art_1": "Scope", "x:anx_II": "Things", "x:anx_II.part_I": "First part", "x:anx_II.part_I.par_3": "Group of things", "x:anx_III": "Correlation table"}
    messages = sorted(tuple(r) for r in act_html.parse_findings(found, nodes).collect() if r["doc_id"] != "v" or "view" in r["message"])
    assert messages == [
        ("d", "error", "Duplicate identifier x:art_1 (X Art. 1)"), ("d", "error", "Duplicate identifier x:art_1.par_1 (X Art. 1(1))"),
        ("d", "warning", "Unknown list marker 'odd_one' in X Annex II, Part I"), ("v", "warning", "Recovered from a saved view of the source"),
    ]
    assert act_html.act_nodes(files.limit(0)).count() == 0


def test_deep_pages(spark):
    page = "<div id='cpt_I'><div id='art_1'>" + "<div>" * 5000 + p("down")
    rows = act_html.act_nodes(spark.createDataFrame([("d", "X", page)], "doc_id string, short_name string, content string")).collect()
    assert {r["node_id"]: r["text"] for r in rows}["x:art_1"] == "down"
