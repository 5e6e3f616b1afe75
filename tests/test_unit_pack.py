import hashlib

from folio.operators import units
from folio.plans import reference

NODES = "article_id long, local_id string, heading string, node_id string, parent_id string, seq long, n_chars int"


def rows(article, heading, *nodes):
    return [(article, str(article), heading if parent is None else None, node, parent, seq, n) for seq, (node, parent, n) in enumerate(nodes)]


def test_parts_members_and_phases(spark):
    found = [
        *rows(1, None, ("a1", None, 2), ("p1", "a1", 3)),
        *rows(4, None, ("a4", None, 10), ("p1", "a4", 30), ("p2", "a4", 40), ("p3", "a4", 20), ("x", "p3", 50), ("y", "p3", 200), ("z", "p3", 5), ("lost", "gone", 1)),
        *rows(5, "Definitions", ("a5", None, 500)),
    ]
    out = {}
    for r in sorted(units.unit_pack(spark.createDataFrame(found, NODES), 100).collect(), key=lambda r: (r["article_id"], r["part"] or 0, r["ordinal"])):
        out.setdefault((r["article_id"], r["unit_id"], r["part"], r["phase"]), []).append(r["node_id"])

    def name(part, ids):
        return f"a4#part-{part:02d}-{hashlib.sha256(chr(0).join(ids).encode()).hexdigest()[:8]}"

    # p3 is too large itself: its parts [p3 x], [p3 y], [p3 z] are packed with the article before them.
    parts = [["a4", "p1", "p2"], ["a4", "p3", "x"], ["a4", "p3", "y"], ["a4", "p3", "z"]]
    want = {(1, "a1", None, "bootstrap"): ["a1", "p1"], (5, "a5", None, "bootstrap"): ["a5"]}
    assert out == want | {(4, name(i, ids), i, "main"): ids for i, ids in enumerate(parts, 1)}


def test_packs_what_unit_plan_would_split(spark):
    sf = "/root/testdata/sf0.001"
    plan = {r["article_id"]: r for r in reference.unit_plan(spark, sf).collect()}
    chars, parts = {}, {}
    for r in reference.unit_pack(spark, sf).collect():
        chars[r["article_id"]] = chars.get(r["article_id"], 0) + r["n_chars"]
        parts.setdefault(r["article_id"], {}).setdefault(r["unit_id"], []).append(r["n_chars"])
    assert chars == {a: r["n_chars"] for a, r in plan.items()}
    assert {a: len(p) == 1 for a, p in parts.items()} == {a: r["whole"] for a, r in plan.items()}
    assert all(sum(n) <= 1500 for p in parts.values() for n in p.values())


def test_no_group_of_pandas_and_order_of_rows_does_not_count(spark):
    found = [*rows(7, None, ("a7", None, 90), ("p1", "a7", 30), ("p2", "a7", 40)), *rows(8, "x", ("a8", None, 1)), (8, None, None, "b8", None, None, 5)]
    frame = spark.createDataFrame(found[::-1], NODES)
    packed = units.unit_pack(frame, 100)
    assert "FlatMapGroupsInPandas" not in packed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["article_id"], r["part"] or 0, r["ordinal"], r["node_id"], r["n_chars"]) for r in packed.collect())
    assert got == [(7, 1, 0, "a7", 90), (7, 1, 1, "p1", 30), (7, 2, 0, "a7", 90), (7, 2, 1, "p2", 40), (8, 0, 0, "a8", 1), (8, 0, 0, "b8", 5)]
