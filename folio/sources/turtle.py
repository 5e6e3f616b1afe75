"""Triples of files in Turtle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed, dealt

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TRIPLE = "doc_id string, seq int, s string, p string, o string, kind string, lang string, datatype string, error string"
#: Rows from which on an Arrow batch is handed on; one file's are never parted.
BATCH = 8192
_LOCAL = r"(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?"
_NAME = rf"(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:{_LOCAL})?"
_IRI = r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
_SKIP = r"(?:\s|\#[^\r\n]*)*+"
_TOKEN = re.compile(rf"""
    (?P<iri>{_IRI}) | (?P<blank>_:\w(?:[\w.\-]*[\w\-])?)
  | (?P<text>\"\"\"(?:\"{{0,2}}(?:[^\"\\]|\\.))*\"\"\"|'''(?:'{{0,2}}(?:[^'\\]|\\.))*'''|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*')
  | (?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s)) | (?P<name>{_NAME}) | (?P<word>(?:a|true|false)(?![\w:\-]))
  | (?P<double>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+) | (?P<decimal>[+-]?\d*\.\d+) | (?P<integer>[+-]?\d+) | (?P<mark>[.;,\[\]()])
""", re.VERBOSE | re.DOTALL)
_BLANKS = re.compile(_SKIP)
_LANG = re.compile(r"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)")
_TYPE = re.compile(rf"\^\^{_SKIP}(?:(?P<iri>{_IRI})|(?P<name>{_NAME}))")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3] is None:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _PLAIN:
            raise ValueError(f"unknown escape \\{m[3]}")
        return _PLAIN[m[3]]

    return _ESCAPE.sub(one, text)


class _Reader:
    """One file. Open statements, blank nodes in brackets and lists stand on a stack, so their depth is not Python's."""

    def __init__(self, doc_id: str, source: str):
        self.doc, self.source, self.at, self.blanks = doc_id, source, 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""

    def _next(self) -> re.Match | None:
        self.at = _BLANKS.match(self.source, self.at).end()
        if self.at == len(self.source):
            return None
        found = _TOKEN.match(self.source, self.at)
        if not found:
            raise ValueError(f"unexpected {self.source[self.at]!r}")
        self.at = found.end()
        return found

    def _iri(self, m: re.Match) -> str:
        if m["iri"]:
            iri = _unescaped(m["iri"][1:-1])
            if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri):
                return iri
            joined = urljoin(self.base, iri)
            return joined + "#" if iri.endswith("#") and not joined.endswith("#") else joined  # an empty fragment stays
        prefix, _, local = m["name"].partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _fresh(self) -> tuple:
        self.blanks += 1
        return (f"_:[{self.blanks}]@{self.doc}", "blank", None, None)

    def _literal(self, m: re.Match) -> tuple:
        quotes = 3 if m["text"][:3] in ('"""', "'''") and len(m["text"]) >= 6 else 1
        text = _unescaped(m["text"][quotes:-quotes])
        if lang := _LANG.match(self.source, self.at):
            self.at = lang.end()
            return (text, "literal", lang[1].lower(), f"{RDF}langString")
        kind = _TYPE.match(self.source, _BLANKS.match(self.source, self.at).end())
        if kind:
            self.at = kind.end()
        return (text, "literal", None, self._iri(kind) if kind else f"{XSD}string")

    def _term(self, m: re.Match) -> tuple:
        """(value, kind, lang, datatype)."""
        if m["iri"] or m["name"]:
            return (self._iri(m), "iri", None, None)
        if m["blank"]:
            return (f"{m['blank']}@{self.doc}", "blank", None, None)
        if m["text"]:
            return self._literal(m)
        if m["word"]:
            return (f"{RDF}type", "iri", None, None) if m["word"] == "a" else (m["word"], "literal", None, f"{XSD}boolean")
        return (m[0], "literal", None, XSD + m.lastgroup)

    def _directive(self, m: re.Match) -> None:
        name = None
        if m[0].lower().endswith("prefix"):
            name = self._next()
            if not name or not name["name"] or not name[0].endswith(":"):
                raise ValueError("a prefix has no name")
        iri = self._next()
        if not iri or not iri["iri"]:
            raise ValueError("a directive has no address")
        if name:
            self.prefixes[name[0][:-1]] = self._iri(iri)
        else:
            self.base = self._iri(iri)
        if m[0].startswith("@"):
            end = self._next()
            if not end or end[0] != ".":
                raise ValueError("a directive does not end")

    def triples(self) -> Iterator[tuple]:
        """(s, p, term). A frame is [kind, subject, predicate, what it waits for]; of a list: [kind, first cell, last cell, "item"]."""
        stack: list[list] = [["file", None, None, "subject"]]
        while m := self._next():
            frame, mark, term = stack[-1], m["mark"], None
            kind, wants = frame[0], frame[3]
            if m["directive"]:
                if (kind, wants) != ("file", "subject"):
                    raise ValueError("a directive within a statement")
                self._directive(m)
                continue
            if mark in ("[", "("):
                if wants not in ("subject", "object", "item"):
                    raise ValueError(f"unexpected {mark!r}")
                stack.append(["node", self._fresh(), None, "first verb"] if mark == "[" else ["list", None, None, "item"])
                continue
            if mark == "]" and kind == "node" and wants in ("first verb", "verb", "end"):
                term, m = frame[1], None
                whole = wants != "first verb"
                stack.pop()
            elif mark == ")" and kind == "list":
                nil = (f"{RDF}nil", "iri", None, None)
                if frame[1]:
                    yield frame[2], f"{RDF}rest", nil
                term, m, whole = frame[1] or nil, None, False
                stack.pop()
            elif mark == "," and wants == "end":
                frame[3] = "object"
                continue
            elif mark == ";" and wants in ("end", "verb"):
                frame[3] = "verb"
                continue
            elif mark == "." and kind == "file" and wants in ("end", "verb"):
                frame[:] = ["file", None, None, "subject"]
                continue
            elif mark:
                raise ValueError(f"unexpected {mark!r}")
            else:
                term, whole = self._term(m), False
            frame = stack[-1]
            if frame[3] == "subject":
                if term[1] == "literal" or m and m["word"]:
                    raise ValueError("a subject is neither an address nor a blank node")
                frame[1], frame[3] = term, "verb" if whole else "first verb"
            elif frame[3] in ("first verb", "verb"):
                if term[1] != "iri":
                    raise ValueError("a predicate is no address")
                frame[2], frame[3] = term[0], "object"
            elif m and m["word"] == "a":
                raise ValueError("unexpected 'a'")
            elif frame[3] == "object":
                yield frame[1], frame[2], term
                frame[3] = "end"
            elif frame[3] == "item":
                cell = self._fresh()
                if frame[1]:
                    yield frame[2], f"{RDF}rest", cell
                yield cell, f"{RDF}first", term
                frame[1], frame[2] = frame[1] or cell, cell
            else:
                raise ValueError("a statement does not end")
        if len(stack) > 1 or stack[0][3] != "subject":
            raise ValueError("the text ends within a statement")


def _rows(doc_id: str, content: bytes | None) -> list[tuple]:
    """All triples of a file, or one row with what is wrong with it and its line."""
    reader = None
    try:
        reader = _Reader(doc_id, (content or b"").decode("utf-8-sig"))
        return [(doc_id, i, s[0], p, o[0], o[1], o[2], o[3], None) for i, (s, p, o) in enumerate(reader.triples())]
    except (ValueError, OverflowError) as e:
        line = reader.source.count("\n", 0, reader.at) + 1 if reader else 1
        return [(doc_id, None, None, None, None, None, None, None, f"line {line}: {e if reader else 'the text is not in UTF-8'}")]


def read(files: DataFrame) -> DataFrame:
    """(doc_id, seq, s, p, o, kind, lang, datatype, error) of files (doc_id, content binary or text), written once.

    kind of o: iri, blank or literal; languages are in lower case; seq is the place of a triple, and repeated triples stay.
    Blank nodes carry their file's doc_id, which is unique. A malformed file is one row with an error and has no triples;
    null content is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 7]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], "doc_id seq s p o kind lang datatype error".split())
        rows: list[tuple] = []
        for batch in batches:
            for doc, content in zip(batch.column("doc_id"), batch.column("content")):
                rows += _rows(doc.as_py(), content.as_py())
                if len(rows) >= BATCH:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return checkpointed(dealt(files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")), "doc_id").mapInArrow(run, _TRIPLE))


def triples(found: DataFrame) -> DataFrame:
    """The distinct triples (s, p, o, kind, lang, datatype) of what was read: the graph of all files."""
    return found.where("error is null").select("s", "p", "o", "kind", "lang", "datatype").distinct()


def findings(found: DataFrame) -> DataFrame:
    """(doc_id, message) of malformed files."""
    return found.where("error is not null").select("doc_id", F.col("error").alias("message"))
