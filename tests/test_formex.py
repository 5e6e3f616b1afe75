from folio.sources import formex

GOLDEN = """<?xml version="1.0" encoding="UTF-8"?>
<ACT xmlns="http://example.org/formex"><PREAMBLE><RECITAL><NO.RECITAL>(1)</NO.RECITAL><TXT>Legal acts require clear structure.</TXT></RECITAL></PREAMBLE>
<BODY><CHAPTER><NO.CHAPTER>I</NO.CHAPTER><TI.CHAPTER><TI>General</TI></TI.CHAPTER><ARTICLE><TI.ART><NO.ART>Article 1</NO.ART><TI>Purpose</TI></TI.ART>
<PARAG><NO.PARAG>1.</NO.PARAG><ALINEA>Manufacturers shall act.</ALINEA><LIST><ITEM><NO.POINT>(a)</NO.POINT><ALINEA>Keep records.</ALINEA></ITEM></LIST></PARAG></ARTICLE></CHAPTER></BODY></ACT>"""
NESTED = """<ACT><PART><NO.PART>A</NO.PART><CHAPTER><ARTICLE IDENTIFIER="001"><TI.ART><NO.ART>Article 7</NO.ART><TI>On <b>words</b></TI></TI.ART>Before <X>in <NO.ART>no</NO.ART> it</X> after</ARTICLE></CHAPTER></PART>
<ARTICLE><NO.ART>Article 7</NO.ART>Again</ARTICLE>
<ANNEX><NO.ANNEX>ANNEX II</NO.ANNEX><TITLE>Things</TITLE>Head<LIST><ITEM><NO.POINT>1.2</NO.POINT>one<LIST><ITEM><NO.ITEM>ii</NO.ITEM>deep</ITEM></LIST></ITEM><ITEM>two</ITEM></LIST><P><LIST><ITEM>lost</ITEM></LIST></P></ANNEX></ACT>"""


def test_six_rows_of_the_golden_act(spark):
    files = spark.createDataFrame([("d", "TEST", GOLDEN.encode())], "doc_id string, short_name string, content binary")
    rows = sorted(formex.act_nodes(files).collect(), key=lambda r: r["seq"])
    got = [(r["node_id"], r["ptype"], r["local_id"], r["citation"], r["parent_id"], r["heading"], r["text"], r["is_normative"], r["marker"]) for r in rows]
    assert got == [
        ("test:preamble", "preamble", "pre", "TEST Preamble", None, "", "", False, ""),
        ("test:rec_1", "recital", "1", "TEST Recital (1)", "test:preamble", "", "(1) Legal acts require clear structure.", False, ""),
        ("test:chap_I", "chapter", "I", "TEST Chapter I", "test:preamble", "General", "", True, ""),
        ("test:art_1", "article", "1", "TEST Art. 1", "test:chap_I", "Purpose", "", True, ""),
        ("test:art_1.par_1", "paragraph", "1", "TEST Art. 1(1)", "test:art_1", "", "Manufacturers shall act.", True, "paragraph"),
        ("test:art_1.par_1.point_a", "point", "a", "TEST Art. 1(1)(a)", "test:art_1.par_1", "", "Keep records.", True, "letter"),
    ]


def test_groups_annexes_and_repeats(spark):
    files = spark.createDataFrame([("d", "X", NESTED.encode()), ("bad", "B", b"<ACT>"), ("dtd", "B", b'<!DOCTYPE a [<!ENTITY x "y">]><ACT/>'), ("other", "B", b"<DOC/>"), ("null", "B", None)], "doc_id string, short_name string, content binary")
    found = formex.elements(files)
    nodes = formex.act_nodes(files, found)
    got = {r["node_id"]: r for r in nodes.collect()}
    assert list(dict(sorted(got.items(), key=lambda x: x[1]["seq"]))) == ["x:preamble", "x:part_A", "x:part_A.chap_1", "x:art_7", "x:anx_II", "x:anx_II.point_1_2", "x:anx_II.point_1_2.point_ii", "x:anx_II.point_2"]
    art = got["x:art_7"]
    assert (art["parent_id"], art["copies"], art["text"], art["heading"]) == ("x:part_A.chap_1", 2, "Again", "")
    assert got["x:part_A"]["heading"] == "On words" and got["x:part_A.chap_1"]["citation"] == "X Part A Chapter 1"
    annex = got["x:anx_II"]
    assert (annex["heading"], annex["text"], annex["parent_id"], annex["citation"]) == ("Things", "Things Head", "x:preamble", "X Annex II")
    assert got["x:anx_II.point_1_2.point_ii"]["citation"] == "X Annex II(1.2)(ii)" and got["x:anx_II.point_1_2.point_ii"]["marker"] == "roman"
    assert got["x:anx_II.point_1_2"]["text"] == "one" and got["x:anx_II.point_2"]["text"] == "two"
    messages = sorted((r["doc_id"], r["message"][:20]) for r in formex.parse_findings(files, found, nodes).collect())
    assert messages == [("bad", "not well formed: no "), ("d", "Duplicate identifier"), ("dtd", "document types are n"), ("null", "not well formed: no "), ("other", "the root is no ACT")]
