"""Signals that rules find in provisions: definitions, references, modal verbs, time limits, dates.

A provision is a row of a node table: node_id, seq, ptype, citation, parent_id, marker, is_normative, text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed

# Words, names of acts and patterns of legal English. Of modals with the same start the longer comes first.
MODALS = ["shall not", "shall", "may not", "may", "should"]
MONTHS = "January February March April May June July August September October November December".split()
DATE = rf"(\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}})"
DEFINITION = r"(?s)^‘([^’]+)’(?:,\s*‘[^’]+’)*(?:\s+and\s+‘[^’]+’)?(?:\s+or\s+‘([^’]+)’)?(?:\s+of the [\w ]+?)?(?:,\s*[^‘’,]{3,80},)?\s+means?:?\s*(.*)$"
BY_REFERENCE = r"(?:as defined in|pursuant to|listed in) ((?:points? \(\w+\) of )?(?:Article|Annex) [\w\s(),]+?(?:of|to) (?:Regulation|Directive|Decision|Recommendation) (?:\((?:EU|EC)\))?(?: No)? ?\d+/\d+)"
MODERN_ACT = r"(?:Regulation|Directive|Decision) \((?:EU|EC|EEC|Euratom)\)(?: No)? \d+/\d+"
OLD_ACT = r"(?:Regulation|Directive|Decision) \d{2,4}/\d+/(?:EC|EEC|EU)"
#: Kinds of dated events in order of priority.
EVENTS = [
    ("transposition_deadline", rf"(?:[Bb]y {DATE},? Member States shall adopt and publish|adopt and publish,? by {DATE})"),
    ("national_measures_apply_from", rf"apply those measures from {DATE}"),
    ("with_effect_from", rf"with effect from {DATE}"),
    ("dated_task", rf"\b[Bb]y {DATE}"),
]
APPLIES = r"(Article \d+|Chapter [IVX]+(?: \(Articles \d+ to \d+\))?|This Regulation|It|it) shall apply from (\d{1,2} \w+ \d{4})"
LISTED = rf"^((?:Articles?|Chapters?|Annex(?:es)?|Points?|Sections?)\b.*?) from {DATE}"
INSTITUTIONS = ["THE EUROPEAN PARLIAMENT AND THE COUNCIL OF THE EUROPEAN UNION,", "THE EUROPEAN COMMISSION,", "Having regard"]
#: (?U): letters, digits and white space of all scripts.
_DURATION = r"(?U)\b(?:within|no later than|after|exceeding|at least(?: until)?|for at least)\s+(?:\d+|one|two|three|six)\s+(?:hours?|days?|months?|years?)\b"
#: Characters around an event of the same date within which a second one is left out; characters of context.
NEAR, CONTEXT, APPLY_CONTEXT = 80, 80, 90


def modal_counts(sentences: DataFrame, text: str = "text", modals: Sequence[str] = MODALS) -> DataFrame:
    """(modal, n) over all texts, of normative rows alone where sentences has is_normative; null texts have none. Of modals with the same start the longer counts."""
    pattern = r"(?U)\b(" + "|".join(sorted(modals, key=len, reverse=True)) + r")\b"
    rows = sentences.where("is_normative") if "is_normative" in sentences.columns else sentences
    found = rows.select(F.explode(F.regexp_extract_all(squeezed(F.col(text)), F.lit(pattern), F.lit(1))).alias("modal"))
    return found.groupBy("modal").agg(F.count("*").alias("n"))


def duration_counts(sentences: DataFrame, text: str = "text") -> DataFrame:
    """(match, n) of time limits such as `within 3 days` or `no later than two months`."""
    found = sentences.select(F.explode(F.regexp_extract_all(squeezed(F.col(text)), F.lit(_DURATION), F.lit(0))).alias("match"))
    return found.groupBy("match").agg(F.count("*").alias("n"))


def durations(nodes: DataFrame) -> DataFrame:
    """(seq, citation, place, match): one row for each time limit of each normative node, in order of place from 0."""
    found = F.posexplode(F.regexp_extract_all(squeezed(F.col("text")), F.lit(_DURATION), F.lit(0))).alias("place", "match")
    return nodes.where("is_normative").select("seq", "citation", found)


def definitions(nodes: DataFrame) -> DataFrame:
    """(citation, term, alias, by_reference) of nodes of the type definition that say what a quoted term means."""
    t = squeezed(F.col("text"))
    found = nodes.where(F.col("ptype") == "definition").where(t.rlike(DEFINITION))
    body = F.regexp_extract(t, DEFINITION, 3)
    return found.select("citation", F.regexp_extract(t, DEFINITION, 1).alias("term"), F.nullif(F.regexp_extract(t, DEFINITION, 2), F.lit("")).alias("alias"), F.nullif(F.regexp_extract(body, BY_REFERENCE, 1), F.lit("")).alias("by_reference"))


def external_references(nodes: DataFrame) -> DataFrame:
    """(act, n, first_seq) of acts that any node names, as `Type (EU) n/n` or `Type n/n/EC`; first_seq orders acts of the same number."""
    found = nodes.select("seq", F.explode(F.regexp_extract_all(squeezed(F.col("text")), F.lit(f"{MODERN_ACT}|{OLD_ACT}"), F.lit(0))).alias("act"))
    return found.groupBy(F.replace("act", F.lit(" No "), F.lit(" ")).alias("act")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


_EVENT = "kind string, date string, at int"


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches with their places, kind by kind; Spark's functions give a match or its place, not all places."""
    patterns = [(kind, re.compile(p)) for kind, p in EVENTS]
    for batch in batches:
        seqs, kinds, dates, contexts, cites = [], [], [], [], []
        for seq, cite, text in zip(*(batch.column(c).to_pylist() for c in ("seq", "citation", "text"))):
            seen: list[tuple[str, int]] = []
            for kind, pattern in patterns:
                for m in pattern.finditer(text):
                    date = next(filter(None, m.groups()))
                    if not any(d == date and abs(m.end() - e) < NEAR for d, e in seen):
                        seen.append((date, m.end()))
                        for column, value in zip((seqs, kinds, dates, contexts, cites), (seq, kind, date, text[max(0, m.start() - CONTEXT) : m.start()], cite)):
                            column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), *(pa.array(x, pa.string()) for x in (cites, kinds, dates, contexts))], ["seq", "citation", "kind", "date", "context"])


def dated_events(nodes: DataFrame) -> DataFrame:
    """(seq, citation, kind, date, context). Kinds are tried in order; a match that ends near an earlier one of the same date in its node is left out."""
    rows = nodes.select(F.col("seq").cast("long").alias("seq"), "citation", squeezed(F.col("text")).alias("text"))
    return rows.where(F.col("text").rlike(DATE)).mapInArrow(_events, "seq long, citation string, kind string, date string, context string")


def listed_application_dates(nodes: DataFrame) -> DataFrame:
    """(seq, citation, scope, date, context) of lettered or numbered items `Articles ... from DATE` below a node that says `shall apply`."""
    above = nodes.where(F.col("text").contains("shall apply")).select(F.col("node_id").alias("parent_id"), F.col("citation").alias("of"))
    t = squeezed(F.col("text"))
    found = nodes.where(F.col("marker").isin("letter", "num") & t.rlike(LISTED)).join(above, "parent_id")
    scope = F.regexp_replace(F.regexp_extract(t, LISTED, 1), r"\s+shall apply$", "")
    return found.select("seq", "citation", scope.alias("scope"), F.regexp_extract(t, LISTED, 2).alias("date"), F.concat(F.lit("list in "), F.col("of")).alias("context"))


def application_dates(nodes: DataFrame) -> DataFrame:
    """(seq, citation, place, scope, date) of `X shall apply from DATE`; `it` is the Regulation itself."""
    t = squeezed(F.col("text"))
    every = F.arrays_zip(F.regexp_extract_all(t, F.lit(APPLIES), F.lit(1)).alias("scope"), F.regexp_extract_all(t, F.lit(APPLIES), F.lit(2)).alias("date"))
    found = nodes.select("seq", "citation", F.posexplode(every).alias("place", "m"))
    return found.select("seq", "citation", "place", F.when(F.lower("m.scope") == "it", "This Regulation").otherwise(F.col("m.scope")).alias("scope"), F.col("m.date").alias("date"))


def title_amended_acts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, act): numbers of acts after `amending` in what stands before the institutions, up to `and repealing` or a remark in brackets."""
    head = squeezed(F.get(F.split(F.col(text_col), "|".join(INSTITUTIONS)), F.lit(0)))
    part = F.regexp_extract(head, r"\bamending (.*?)(?:\band repealing\b|\(Text with|\(Artificial|\(Cyber|$)", 1)
    old = F.regexp_extract_all(part, F.lit(r"\b(\d{2,4}/\d+/(?:EC|EEC|EU))\b"), F.lit(1))
    new = F.regexp_extract_all(part, F.lit(r"(?:\((?:EU|EC|EEC)\)|,|and)\s*(?:No\s*)?(\d{2,4}/\d{1,4})\b(?!/)"), F.lit(1))
    return documents.select(F.col(id_col).alias("doc_id"), F.explode(F.array_union(old, new)).alias("act"))
