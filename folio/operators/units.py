"""Extraction units: which nodes are planned, and how many provisions and characters each holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def subtree_sizes(paragraphs: DataFrame, points: DataFrame) -> DataFrame:
    """(article_id, n_nodes, n_chars): an article with its paragraphs and their points. Points are summed before they meet their paragraphs."""
    below = points.groupBy("paragraph_id").agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("chars"))
    joined = paragraphs.join(below, "paragraph_id", "left")
    sums = joined.groupBy("article_id").agg(F.count("*").alias("paragraphs"), F.sum(F.coalesce("points", F.lit(0))).alias("points"), F.sum(F.coalesce("chars", F.lit(0))).alias("n_chars"))
    return sums.select("article_id", (F.col("paragraphs") + F.col("points") + 1).alias("n_nodes"), "n_chars")


def unit_plan(sizes: DataFrame, max_chars: int = 1500) -> DataFrame:
    """(article_id, n_chars, whole): an article is one unit where its subtree has at most max_chars, else unit_pack splits it."""
    return sizes.select("article_id", "n_chars", (F.col("n_chars") <= max_chars).alias("whole"))


#: Articles of the bootstrap phase where an act has no profile of its own.
BOOTSTRAP = ("1", "2", "3")
_PARTS = "article_id long, unit_id string, part int, phase string, ordinal int, node_id string, n_chars long"


def partition_subtree(root: str, children: dict[str, list[str]], chars: dict[str, int], max_chars: int) -> list[list[str]]:
    """Node ids of the parts of root's subtree, each in pre-order.

    A subtree of at most max_chars is one part, as is a node without children. Otherwise the parts of the children
    are put together in order while they fit; root stands at the head of each part and its text counts in each.
    """

    def below(node: str) -> tuple[list[str], int]:
        ids, size, pending = [], 0, [node]
        while pending:
            at = pending.pop()
            ids.append(at)
            size += chars[at]
            pending += reversed(children.get(at, ()))
        return ids, size

    ids, size = below(root)
    if size <= max_chars or not children.get(root):
        return [ids]
    parts: list[list[str]] = []
    current, total = [], chars[root]
    for child in children[root]:
        for piece in partition_subtree(child, children, chars, max_chars):
            size = sum(chars[i] for i in piece)
            if current and total + size > max_chars:
                parts.append([root, *current])
                current, total = [], chars[root]
            current += piece
            total += size
    return [*parts, [root, *current]]


def unit_pack(nodes: DataFrame, max_chars: int = 1500, bootstrap: Sequence[str] = BOOTSTRAP) -> DataFrame:
    """(article_id, unit_id, part, phase, ordinal, node_id, n_chars): one row for each node of each unit, ordinal from 0 within it.

    nodes: article_id, local_id, heading, node_id, parent_id (null for the article itself), seq (order among
    siblings), n_chars. A whole article is one unit with the article's node id and no part; a split one has parts from 1, named
    by their number and a hash of their nodes. Nodes whose parent is missing belong to no unit.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    first, names = set(bootstrap), [c.split()[0] for c in _PARTS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64()]

    def packed(article: int, rows: list[tuple]) -> Iterator[tuple]:
        chars: dict[str, int] = {}
        children: dict[str, list[str]] = {}
        for local_id, heading, node, parent, n in rows:
            chars[node] = n
            if parent is not None:
                children.setdefault(parent, []).append(node)
        for local_id, heading, root, parent, _ in rows:
            if parent is not None:
                continue
            phase = "bootstrap" if local_id in first or "definition" in (heading or "").casefold() else "main"
            parts = partition_subtree(root, children, chars, max_chars)
            for number, ids in enumerate(parts, 1):
                member = hashlib.sha256("\0".join(ids).encode()).hexdigest()[:8] if len(parts) > 1 else None
                unit, part = (root, None) if len(parts) == 1 else (f"{root}#part-{number:02d}-{member}", number)
                for i, node in enumerate(ids):
                    yield article, unit, part, phase, i, node, chars[node]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        article, rows, out = None, [], []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)
        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("article_id", "local_id", "heading", "node_id", "parent_id", "n_chars"))):
                if own != article or not rows:
                    out += packed(article, rows)
                    article, rows = own, []
                rows.append(row)
            yield as_batch()
            out.clear()
        out += packed(article, rows)
        yield as_batch()

    # Articles follow one another in a task, each in the order of its nodes; one article is held at a time.
    placed = nodes.select("article_id", "local_id", "heading", "node_id", "parent_id", "seq", "n_chars").repartition("article_id").sortWithinPartitions("article_id", F.col("seq").asc_nulls_last(), F.col("node_id").asc_nulls_last())
    return placed.mapInArrow(run, _PARTS)


# Acts whose bootstrap phase has articles and annexes of its own; types of annex children that are planned by themselves.
PROFILES = {"CRA": (["1", "2", "3"], ["III", "IV"]), "AIA": (["1", "2", "3", "5", "6"], ["I", "III"])}
GROUPS = ["part", "chapter", "section", "annex_chapter"]


def profiles(spark: SparkSession) -> DataFrame:
    """(short_name, articles, annexes) of the acts in PROFILES."""
    return spark.createDataFrame([(name, *lists) for name, lists in PROFILES.items()], "short_name string, articles array<string>, annexes array<string>")


def with_ordinals(nodes: DataFrame) -> DataFrame:
    """nodes (doc_id, node_id, parent_id, seq) with `ordinal`, the place among the children of one parent, from 0."""
    return nodes.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("seq")) - 1)


def descendants(nodes: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """(doc_id, root_id, node_id, depth, place): each root with all nodes below it; place sorts them in pre-order. A loop in the tree is an error after `most` levels.

    nodes has ordinal. One join a level over the rows of that level alone, whatever the number of trees.
    """
    child = nodes.select("doc_id", F.col("parent_id").alias("above"), F.col("node_id").alias("below"), F.col("ordinal").alias("o"))
    level = roots.select("doc_id", F.col("node_id").alias("root_id"), "node_id", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place"))
    level = cut(level.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"]).select("doc_id", "root_id", "node_id", "depth", "place"))
    found = level
    for depth in range(1, most + 1):
        level = level.join(child, (child.doc_id == level.doc_id) & (child.above == level.node_id)).select(level.doc_id, "root_id", F.col("below").alias("node_id"), F.lit(depth).alias("depth"), F.array_append("place", F.col("o").cast("int")).alias("place"))
        level = cut(level)
        if level.isEmpty():
            return found
        found = found.union(level)
    raise ValueError("the tree is deeper than the levels allowed, or has a loop")


def unit_roots(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, seq, annex_id) of articles, of the grouped children of annexes, and of annexes without such children. annex_id is the annex of a grouped child or the annex itself."""
    annexes = nodes.where("ptype = 'annex'").select("doc_id", F.col("node_id").alias("annex_id"), "seq")
    grouped = nodes.where(F.col("ptype").isin(GROUPS)).select("doc_id", "node_id", "seq", F.col("parent_id").alias("annex_id")).join(annexes.drop("seq"), ["doc_id", "annex_id"], "left_semi").select("doc_id", "node_id", "seq", "annex_id")
    whole = annexes.join(grouped.select("doc_id", "annex_id"), ["doc_id", "annex_id"], "left_anti").select("doc_id", F.col("annex_id").alias("node_id"), "seq", "annex_id")
    articles = nodes.where("ptype = 'article'").select("doc_id", "node_id", "seq", F.lit(None).cast("string").alias("annex_id"))
    return articles.union(grouped).union(whole)


def phased_roots(nodes: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, node_id, seq, phase): bootstrap for the articles and annexes of the act's profile and for what a heading calls definitions, else main.

    documents: doc_id, short_name. known: profiles. An annex is meant by its local id or by `ANNEX id` in its citation.
    """
    upper = documents.select("doc_id", F.upper("short_name").alias("short_name")).join(F.broadcast(known), "short_name", "left")
    chosen = upper.select("doc_id", F.coalesce("articles", F.array(*map(F.lit, BOOTSTRAP))).alias("articles"), F.coalesce("annexes", F.array().cast("array<string>")).alias("annexes"))
    own = nodes.select("doc_id", "node_id", "ptype", "local_id", F.lower("heading").alias("heading"))
    annex = nodes.where("ptype = 'annex'").select("doc_id", F.col("node_id").alias("annex_id"), F.upper(F.trim("local_id")).alias("annex_local"), F.upper("citation").alias("annex_citation"))
    rows = unit_roots(nodes).join(own, ["doc_id", "node_id"]).join(annex, ["doc_id", "annex_id"], "left").join(chosen, "doc_id")
    named = F.exists("annexes", lambda t: (F.col("annex_local") == t) | F.regexp_like("annex_citation", F.concat(F.lit(r"\bANNEX\s+"), t, F.lit(r"\b"))))
    early = (F.col("ptype") == "article") & F.array_contains("articles", F.col("local_id")) | F.coalesce(named, F.lit(False)) | F.coalesce(F.contains("heading", F.lit("definition")), F.lit(False))
    return rows.select("doc_id", "node_id", "seq", F.when(early, "bootstrap").otherwise("main").alias("phase"))


_UNITS = "doc_id string, phase string, root_id string, root_seq long, unit_id string, part int, ordinal int, node_id string, n_chars long"


def extraction_units(nodes: DataFrame, documents: DataFrame, known: DataFrame, max_chars: int = 8000, limit: int | None = None) -> DataFrame:
    """(doc_id, phase, root_id, root_seq, unit_id, part, ordinal, node_id, n_chars): the nodes of every unit of every act in its phase.

    nodes: doc_id, node_id, parent_id, seq, ptype, local_id, citation, heading, text. With limit, the first units of each act and phase.
    A root's subtree is packed by itself, so the work is dealt out by root and not by act.
    """
    if max_chars < 1 or limit is not None and limit < 1:
        raise ValueError("max_chars and limit must be positive")
    placed = with_ordinals(nodes)
    roots = phased_roots(placed, documents, known)
    sized = placed.select("doc_id", "node_id", "parent_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    trees = descendants(placed, roots).join(sized, ["doc_id", "node_id"]).join(roots.select("doc_id", F.col("node_id").alias("root_id"), F.col("seq").alias("root_seq"), "phase"), ["doc_id", "root_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(place=[tuple(p) for p in pdf["place"]]).sort_values("place")
        first, children = pdf.iloc[0], {}
        for node, parent in zip(pdf["node_id"][1:], pdf["parent_id"][1:]):
            children.setdefault(parent, []).append(node)
        chars = dict(zip(pdf["node_id"], pdf["n_chars"]))
        parts, out = partition_subtree(first.root_id, children, chars, max_chars), []
        for number, ids in enumerate(parts, 1):
            member = hashlib.sha256("\0".join(ids).encode()).hexdigest()[:8]
            unit, part = (first.root_id, None) if len(parts) == 1 else (f"{first.root_id}#part-{number:02d}-{member}", number)
            out += [(first.doc_id, first.phase, first.root_id, first.root_seq, unit, part, i, node, chars[node]) for i, node in enumerate(ids)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _UNITS.split(", ")]).astype({"part": "Int32"})

    units = trees.groupBy("doc_id", "root_id").applyInPandas(run, _UNITS)
    if limit is None:
        return units
    order = Window.partitionBy("doc_id", "phase").orderBy("root_seq", F.coalesce("part", F.lit(0)))
    return units.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= limit).drop("rank")


def plan_listing(units: DataFrame) -> DataFrame:
    """(doc_id, phase, unit_id, n_nodes) of extraction units."""
    return units.groupBy("doc_id", "phase", "unit_id").agg(F.count("*").alias("n_nodes"))


def unit_contexts(units: DataFrame, nodes: DataFrame, dates: DataFrame) -> DataFrame:
    """(doc_id, unit_id, context): JSON of a unit's provisions in order and of the application dates (doc_id, provision, kind, date) that name one of them by citation or id.

    Of parents and children those outside the unit are left out.
    """
    own = units.select("doc_id", "unit_id", "ordinal", "node_id")
    rows = own.join(nodes.select("doc_id", "node_id", "citation", "ptype", "local_id", "parent_id", "heading", "text", "is_normative", "seq"), ["doc_id", "node_id"])
    inside = own.select("doc_id", "unit_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("inside")).distinct()
    rows = rows.join(inside, ["doc_id", "unit_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("inside"), F.col("parent_id")))
    children = rows.where("parent_id is not null").groupBy("doc_id", "unit_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda x: x["node_id"]).alias("children"))
    full = rows.join(children, ["doc_id", "unit_id", "node_id"], "left")
    none = F.array().cast("array<string>")
    row = F.struct("ordinal", F.struct(F.col("node_id").alias("id"), "citation", "ptype", F.col("local_id").alias("localId"), F.col("parent_id").alias("parent"), "heading", "text", F.coalesce("is_normative", F.lit(False)).alias("isNormative"), F.coalesce("children", none).alias("children")).alias("p"))
    provisions = full.groupBy("doc_id", "unit_id").agg(F.transform(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).otherwise(1)), lambda x: x["p"]).alias("provisions"))
    names = rows.select("doc_id", "unit_id", F.explode(F.array("citation", "node_id")).alias("provision")).distinct()
    dated = dates.join(names, ["doc_id", "provision"]).groupBy("doc_id", "unit_id").agg(F.array_sort(F.collect_set(F.struct("provision", "kind", "date"))).alias("applicationDates"))
    joined = provisions.join(dated, ["doc_id", "unit_id"], "left")
    empty = F.coalesce("applicationDates", F.array().cast("array<struct<provision:string,kind:string,date:string>>")).alias("applicationDates")
    return joined.select("doc_id", "unit_id", F.to_json(F.struct("unit_id", "provisions", empty), {"ignoreNullFields": "false"}).alias("context"))
