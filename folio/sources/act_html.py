"""Acts in HTML as a node table.

A small reader per file finds the blocks of an act (recitals, groups, articles, annexes, list rows) and what each holds;
kinds of markers, numbers, ids, repeats and citations come from windows and joins over those rows of all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..functions.text import page_marker

# Forms of ids and headings of acts in HTML.
PARAGRAPH_ID = re.compile(r"\d{3}\.\d{3}")
GROUP_HEADING = re.compile(r"(Section|Part|PART|Class)\s+([IVX]+|[A-Z]|\d+)\b\.?\s*[—–-]?\s*(.*)")
NUMBERED_HEADING = re.compile(r"(\d+)\.\s+(.+)")
ENUMERATED = re.compile(r"(\d+(?:\.\d+)*)\.\s+(.*)")
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: What the start of each of these ends, where it is the innermost open element.
_ENDS = {"p": {"p"}, "div": {"p"}, "table": {"p"}, "td": {"p", "td"}, "tr": {"p", "td", "tr"}}

_BLOCK = "doc_id string, seq int, kind string, mark string, heading string, text string, parent int, chain array<int>, frame int, dashes int, defining boolean, in_group boolean, recovered boolean"


class _Element:
    def __init__(self, tag: str, attributes: dict):
        self.tag, self.id, self.classes = tag, attributes.get("id") or "", (attributes.get("class") or "").split()
        self.children: list = []

    def elements(self, tag: str = "") -> list[_Element]:
        return [c for c in self.children if isinstance(c, _Element) and (not tag or c.tag == tag)]

    def all(self, tag: str = "") -> Iterator[_Element]:
        """Every element (of the tag) inside, in page order."""
        pending = self.elements()[::-1]
        while pending:
            e = pending.pop()
            if not tag or e.tag == tag:
                yield e
            pending += e.elements()[::-1]

    def strings(self, notes: bool = True) -> list[str]:
        out, pending = [], [self]
        while pending:
            e = pending.pop()
            if isinstance(e, str):
                out.append(e)
            elif notes or not (e.tag in ("a", "span") and "oj-note-tag" in e.classes):
                pending += e.children[::-1]
        return out

    def text(self) -> str:
        """What is to be seen, in single spaces, without calls of footnotes."""
        return " ".join(" ".join(self.strings(notes=False)).split())

    def rows(self) -> list[_Element]:
        return self.elements("tr") or [r for body in self.elements("tbody") for r in body.elements("tr")]


class _Reader(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open[-1].tag in _ENDS.get(tag, ()):
            self.open.pop()
        e = _Element(tag, dict(attrs))
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class _Act:
    """The blocks of one act. A block is a dict; `chain` are the blocks that its id is made of, itself included."""

    def __init__(self, root: _Element):
        self.blocks: list[dict] = []
        self.frames = 0
        preamble = self._add("preamble", None, mark="pre")
        divs = list(root.all("div"))
        for d in divs:
            if m := re.fullmatch(r"rct_(\d+)", d.id):
                cells = list(d.all("td"))
                self._add("recital", preamble, mark=m[1], chain=[])["texts"].append(cells[1].text() if len(cells) > 1 else re.sub(r"^\(\d+\)\s*", "", d.text()))
        for d in divs:
            if m := re.fullmatch(r"cpt_([IVXL]+)", d.id):
                chapter = self._add("chapter", None, mark=m[1], heading=self._title(d))
                for s in d.elements("div"):
                    if n := re.fullmatch(rf"cpt_{m[1]}\.sct_(\d+)", s.id):
                        self._articles(s, self._add("section", chapter, mark=n[1], heading=self._title(s)))
                self._articles(d, chapter)
        for d in divs:
            if (m := re.fullmatch(r"anx_([IVXL]+)", d.id)) and "eli-container" in d.classes:
                self._annex(d, m[1])

    def _add(self, kind: str, parent: dict | None, mark: str = "", heading: str = "", chain: list | None = None, frame: int = 0, dashes: int = 0, defining: bool = False) -> dict:
        seq = len(self.blocks)
        above = chain if chain is not None else parent["chain"] if parent else []
        b = {"seq": seq, "kind": kind, "mark": mark, "heading": heading, "texts": [], "parent": parent and parent["seq"], "chain": [*above, seq], "frame": frame, "dashes": dashes, "defining": defining, "in_group": bool(parent) and parent["kind"] in ("annex", "part"), "children": 0}
        if parent:
            parent["children"] += 1
        self.blocks.append(b)
        return b

    @staticmethod
    def _title(d: _Element) -> str:
        lines = next(([p.text() for p in t.all("p")] for t in d.elements("div") if "eli-title" in t.classes), [])
        return lines[-1] if lines else ""

    def _articles(self, d: _Element, parent: dict) -> None:
        for a in d.elements("div"):
            if m := re.fullmatch(r"art_(\d+)", a.id):
                heading = next((t.text() for t in a.elements("div") if "eli-title" in t.classes), "")
                article = self._add("article", parent, mark=m[1], heading=heading, chain=[])
                defines = heading.lower() == "definitions"
                divided = [p for p in a.elements("div") if PARAGRAPH_ID.fullmatch(p.id)]
                for p in divided:
                    self._walk(p.elements(), self._add("paragraph", article, mark=str(int(p.id[4:]))), defines)
                if not divided:
                    self._walk(a.elements(), article, defines)

    def _annex(self, d: _Element, mark: str) -> None:
        heading = " ".join([p.text() for p in d.elements("p") if "oj-doc-ti" in p.classes][1:])
        annex = self._add("correlation_annex" if "correlation table" in heading.lower() else "annex", None, mark=mark, heading=heading)
        target, base, held, untitled = annex, annex, [], False
        for e in d.elements():
            grouping = e.tag == "p" and "oj-ti-grseq-1" in e.classes
            if untitled and "oj-ti-grseq-1" in e.classes:
                target["heading"], untitled = e.text(), False
                continue
            untitled = False
            if e.tag == "p" and "oj-doc-ti" in e.classes:
                continue
            part, numbered = (GROUP_HEADING.fullmatch(e.text()), NUMBERED_HEADING.fullmatch(e.text())) if grouping else (None, None)
            if not part and not numbered:
                held.append(e)
                continue
            self._walk(held, target)
            held = []
            if part:
                target = base = self._add("part", annex, mark=f"{part[1].capitalize()} {part[2]}", heading=part[3])
                untitled = not part[3]
            else:
                target = self._add("group", base, mark=numbered[1], heading=numbered[2])
        self._walk(held, target)

    def _walk(self, elements: list[_Element], target: dict, defines: bool = False) -> None:
        """Runs frames within frames by a list, as pages may be deep."""
        pending = [self._frame(elements, target, defines, 0)]
        while pending:
            inner = next(pending[-1], None)
            if inner is None:
                pending.pop()
            else:
                pending.append(inner)

    def _frame(self, elements: list[_Element], target: dict, defines: bool, dashes: int) -> Iterator[Iterator]:
        """What elements hold goes to target, to list rows, and after a list to subparagraphs; gives the frames of what is inside."""
        self.frames += 1
        frame, current, listed = self.frames, target, False
        dashes = dashes or frame
        for e in elements:
            if e.tag == "p" and ("oj-normal" in e.classes or not e.classes):
                if not (text := e.text()):
                    continue
                if (target["texts"] or target["children"]) and listed:
                    current, listed = self._add("subparagraph", target), False
                current["texts"].append(text)
            elif e.tag == "table":
                listed = True
                for cells in (r.elements("td") for r in e.rows()):
                    if len(cells) > 1:
                        mark = next((t for t in (c.text() for c in cells[-2::-1]) if t), "")
                        row = self._add("item", current, mark=mark, frame=frame, dashes=dashes, defining=defines and current is target)
                        yield self._frame(cells[-1].elements(), row, False, 0)
            elif e.tag == "div" and "eli-title" not in e.classes:
                if PARAGRAPH_ID.fullmatch(e.id):  # of another act, which is quoted
                    current["texts"] += [e.text()] if e.text() else []
                elif "oj-enumeration-spacing" in e.classes and (m := ENUMERATED.fullmatch(e.text())):
                    listed = True
                    self._add("item", target, mark=m[1] if "." in m[1] else f"{m[1]}.", frame=frame, dashes=dashes)["texts"].append(m[2])
                else:
                    yield self._frame(e.elements(), current, defines, dashes)
            elif e.tag == "span":
                current["texts"] += [e.text()] if e.text() else []


def _read(source: str) -> tuple[list[dict], bool]:
    """The blocks of an act, and whether it was a browser's view of its source, which is read instead."""
    root = _Reader(source).root
    view = next((e for e in root.all() if "source-container" in e.classes), None)
    lines = [c for c in view.all("td") if "line-content" in c.classes] if view else []
    if lines:
        root = _Reader("\n".join("".join(c.strings()) for c in lines)).root
    return _Act(root).blocks, bool(lines)


def blocks(files: DataFrame) -> DataFrame:
    """The blocks of files (doc_id, content binary or text) in the order in which their ids are given, written once, since many joins read them. Null content counts as empty; doc_id is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, numbers = pa.string(), pa.int32()
        kinds = {"seq": numbers, "kind": whole, "mark": whole, "heading": whole, "text": whole, "parent": numbers, "chain": pa.list_(numbers), "frame": numbers, "dashes": numbers, "defining": pa.bool_(), "in_group": pa.bool_()}
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                found, recovered = _read((content or b"").decode("utf-8", "replace"))
                rows = [b | {"text": " ".join(b["texts"])} for b in found]
                columns = [pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), whole), *columns, pa.array([recovered] * len(rows))], ["doc_id", *kinds, "recovered"])

    return checkpointed(files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, _BLOCK))


def _marked(found: DataFrame) -> DataFrame:
    """found with the kind of each item's marker, `label` and `step`, its part of an id."""
    before = Window.partitionBy("doc_id", "frame").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    item = F.col("kind") == "item"
    own = F.regexp_extract("mark", r"^[\s‘’'\"“”]*\(([a-z])\)\s*$", 1)
    sure = F.when(item & (own != "") & ~own.isin("i", "v", "x"), own)
    rows = found.withColumn("_sure", F.last(sure, ignorenulls=True).over(before))
    rows = rows.withColumn("_letter", F.when(item & (page_marker(F.col("mark"), F.col("_sure")) == "letter"), own))
    rows = rows.withColumn("_before", F.last("_letter", ignorenulls=True).over(before))
    rows = rows.withColumn("marker", F.when(item, page_marker(F.col("mark"), F.col("_before"))).when(F.col("kind").isin("paragraph", "group"), "paragraph").when(F.col("kind") == "subparagraph", "subpar").otherwise(""))
    nth = F.row_number().over(Window.partitionBy("doc_id", "dashes", "marker").orderBy("seq"))
    sub = F.row_number().over(Window.partitionBy("doc_id", "parent", "kind").orderBy("seq")) + 1
    plain = F.regexp_replace(F.trim("mark"), "^[‘’'\"“”]+", "")
    other = F.left(F.regexp_replace(plain, r"(?U)\W+", "_"), F.lit(12))
    label = F.when(item & (F.col("marker") == "dash"), F.concat(F.lit("dash"), nth)).when(item & (F.col("marker") == "other"), F.coalesce(F.nullif(other, F.lit("")), F.lit("x"))).when(item, F.regexp_replace(plain, r"^\(|\)$|\.$", "")).when(F.col("kind") == "subparagraph", sub.cast("string")).when(F.col("kind") == "part", F.substring_index("mark", " ", -1)).otherwise(F.col("mark"))
    rows = rows.withColumn("label", label)
    k, n = F.col("kind"), F.col("label")
    step = F.when(k == "item", F.concat(F.left("marker", F.lit(3)), F.lit("_"), F.replace(n, F.lit("."), F.lit("_")))).when(k == "part", F.concat(F.lower(F.substring_index("mark", " ", 1)), F.lit("_"), n))
    for kind, short in {"recital": "rec_", "chapter": "chap_", "section": "sec_", "article": "art_", "paragraph": "par_", "annex": "anx_", "correlation_annex": "anx_", "group": "par_", "subparagraph": "subpar_"}.items():
        step = step.when(k == kind, F.concat(F.lit(short), n))
    return rows.withColumn("step", step.otherwise(F.lit("preamble"))).drop("_sure", "_letter", "_before")


def act_nodes(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, seq, ptype, local_id, citation, parent_id, heading, text, is_normative, marker, copy) of files (doc_id, short_name, content).

    An id met again gets `~2`, `~3` and so on, and `copy` says which it is. A paragraph's id holds its article's number as
    it stands. A heading that a group lacks is empty. Empty files have a preamble alone.
    """
    rows = _marked(found if found is not None else blocks(files))
    names = rows.where("kind = 'article'").select("doc_id", F.col("seq").alias("parent"), F.col("step").alias("_article"))
    rows = rows.join(names, ["doc_id", "parent"], "left")
    under = F.when((F.col("kind") == "paragraph"), F.col("_article")).when(F.size("chain") > 1, F.element_at("chain", -2).cast("string")).otherwise("")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", under, "step").orderBy("seq")))
    k, n = F.col("kind"), F.col("label")
    point = F.concat(F.lit(", point "), n)
    piece = F.when(k == "preamble", F.lit(" Preamble")).when(k == "recital", F.concat(F.lit(" Recital ("), n, F.lit(")"))).when(k == "chapter", F.concat(F.lit(" Chapter "), n)).when(k == "section", F.concat(F.lit(" Section "), n)).when(k == "article", F.concat(F.lit(" Art. "), n)).when(k.isin("annex", "correlation_annex"), F.concat(F.lit(" Annex "), n))
    piece = piece.when(k == "part", F.concat(F.lit(", "), F.col("mark"))).when(k == "group", point).when(k == "subparagraph", F.concat(F.lit(", subparagraph "), n))
    piece = piece.when((F.col("marker") == "decimal") | (F.col("marker") == "paragraph") & F.col("in_group"), point).otherwise(F.concat(F.lit("("), n, F.lit(")")))
    again = F.when(F.col("copy") > 1, F.concat(F.lit("~"), F.col("copy"))).otherwise("")
    told = rows.select("doc_id", F.col("seq").alias("a_seq"), F.struct(F.concat("step", again).alias("step"), F.when(k == "article", F.col("step")).alias("plain"), piece.alias("piece"), k.isin("article", "paragraph", "annex", "correlation_annex", "part").alias("base"), (F.col("marker") == "decimal").alias("decimal")).alias("a"))
    links = rows.select("doc_id", "seq", F.posexplode("chain").alias("level", "a_seq")).join(told, ["doc_id", "a_seq"])
    chained = links.groupBy("doc_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "a"))), lambda x: x["a"]).alias("c"))
    # A decimal's citation goes on from that of its act's own division, whatever list it is in.
    bases = F.size(F.filter("c", lambda a: a["base"]))
    decimals = F.filter(F.transform("c", lambda a, i: F.when(a["decimal"], i + 1)), lambda i: i.isNotNull())
    kept = F.when(F.size(decimals) > 0, F.concat(F.slice("c", F.lit(1), bases), F.slice("c", F.array_max(decimals), F.size("c")))).otherwise(F.col("c"))
    # Paragraphs, second in their chains, do not tell which of the articles of one number is theirs.
    steps = F.transform("c", lambda a, i: F.when((i == 0) & a["plain"].isNotNull() & F.coalesce(F.get("c", F.lit(1))["base"], F.lit(False)), a["plain"]).otherwise(a["step"]))
    short = files.select(F.col("doc_id").cast("string").alias("doc_id"), "short_name")
    rows = rows.join(chained, ["doc_id", "seq"]).join(short, "doc_id")
    rows = rows.withColumns({"node_id": F.concat(F.lower("short_name"), F.lit(":"), F.array_join(steps, ".")), "citation": F.concat("short_name", F.array_join(F.transform(kept, lambda a: a["piece"]), ""))})
    parents = rows.select("doc_id", F.col("seq").alias("parent"), F.col("node_id").alias("parent_id"))
    ptype = F.when(k == "group", "paragraph").when(k != "item", k).when(F.col("defining") & (F.col("marker") == "num"), "definition").when(F.col("marker") == "paragraph", "paragraph").otherwise("point")
    text = F.when(k == "paragraph", F.regexp_replace("text", r"^\d+\.\s*", "")).otherwise(F.col("text"))
    return rows.join(parents, ["doc_id", "parent"], "left").select("doc_id", "node_id", "seq", ptype.alias("ptype"), n.alias("local_id"), "citation", "parent_id", "heading", text.alias("text"), (~k.isin("preamble", "recital")).alias("is_normative"), "marker", "copy")


def parse_findings(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, severity, message): ids met more than once, markers of no known kind, files recovered from a view of their source."""
    repeated = nodes.where("copy > 1").select("doc_id", F.lit("error").alias("severity"), F.concat(F.lit("Duplicate identifier "), F.regexp_replace("node_id", r"~\d+$", ""), F.lit(" ("), "citation", F.lit(")")).alias("message"))
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("citation").alias("above"))
    unknown = nodes.where("marker = 'other'").join(above, ["doc_id", "parent_id"]).select("doc_id", F.lit("warning"), F.concat(F.lit("Unknown list marker '"), "local_id", F.lit("' in "), "above"))
    recovered = found.where("recovered and seq = 0").select("doc_id", F.lit("warning"), F.lit("Recovered from a saved view of the source"))
    return repeated.union(unknown).union(recovered)
