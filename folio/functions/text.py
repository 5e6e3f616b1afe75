"""Column functions on text: hashes, titles, numbers, markers, normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SOFT_HYPHEN = "­"
#: Values of the signs of Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50}
#: Roman numerals that count as markers, smallest first.
SMALL_ROMANS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]


def source_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def source_format(path: Column, requested: Column | None = None) -> Column:
    """pdf, html or fmx by what is asked for, else by the suffix in any case of letters; null where neither tells."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    known = F.when(suffix == ".pdf", "pdf").when(suffix.isin(".html", ".htm"), "html").when(suffix.isin(".xml", ".fmx"), "fmx")
    return known if requested is None else F.coalesce(F.nullif(requested, F.lit("")), known)


def title(html: Column) -> Column:
    """What stands in the first <title> of one line, as it is written; null if there is none."""
    return F.nullif(F.regexp_extract(html, r"<title>(.*?)</title>", 1), F.lit(""))


def canonical(html: Column) -> Column:
    """The address of the page's canonical link; null if there is none."""
    return F.nullif(F.regexp_extract(html, r'rel="canonical"\s+href="([^"]+)"', 1), F.lit(""))


def squeezed(text: Column) -> Column:
    """Every run of white space, of all scripts, as one space; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def dehyphenated(text: Column) -> Column:
    """Soft hyphens and the white space after them are gone; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){SOFT_HYPHEN}\s*", "")


def normal_title(text: Column) -> Column:
    """Only the letters a to z and digits, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def normal_text(text: Column) -> Column:
    """For comparisons: plain quotes and dashes, single spaces, none around , ; ( ) . and :"""
    plain = F.translate(F.replace(text, F.lit(SOFT_HYPHEN), F.lit("")), "‘’“”–—−", "''\"\"---")
    return F.regexp_replace(squeezed(plain), r"\s*([,;().:])\s*", "$1")


def _folded(value: str | None) -> str:
    plain = unicodedata.normalize("NFKC", (value or "").replace(SOFT_HYPHEN, "")).translate(str.maketrans("‘’“”–—", "''\"\"--"))
    return " ".join(plain.split()).casefold()


@F.pandas_udf(StringType())
def normal_evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For the search of quotations: compatibility forms, plain quotes and dashes, single spaces, folded case; null is empty."""
    for some in texts:
        yield some.map(_folded)


def roman_value(numeral: Column) -> Column:
    """The value of a Roman numeral of I, V, X and L; null for any other text."""
    values = F.transform(F.split(numeral, ""), lambda c: F.coalesce(*(F.when(c == sign, value) for sign, value in ROMAN.items()), F.lit(0)))
    signed = F.zip_with(values, F.slice(values, 2, 1_000), lambda own, after: F.when(own < F.coalesce(after, F.lit(0)), -own).otherwise(own))
    return F.when(numeral.rlike("^[IVXL]+$"), F.aggregate(signed, F.lit(0), lambda total, x: total + x))


def number(text: Column, fallback: Column) -> Column:
    """The number that a marker tells: without dots at its end, what one pair of brackets holds, else the last word of letters, digits and inner dots, else the fallback."""
    value = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.+$", "")
    words = F.regexp_extract_all(value, F.lit(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*"), F.lit(0))
    inner = F.regexp_extract(value, r"^\(([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)\)$", 1)
    return F.when(inner != "", inner).when(F.size(words) > 0, F.try_element_at(words, F.lit(-1))).otherwise(fallback.cast("string"))


def item_marker(label: Column) -> Column:
    """letter for one of a to z, num for digits, roman up to x, else empty."""
    return F.when(label.rlike("^[a-z]$"), "letter").when(label.rlike("^[0-9]+$"), "num").when(label.isin(SMALL_ROMANS[:10]), "roman").otherwise("")


def page_marker(marker: Column, letter_before: Column) -> Column:
    """Kind of a marker cell of a page; a Roman numeral of one letter that follows the letter before it is a letter."""
    m = F.regexp_replace(F.trim(marker), "^[‘’'\"“”]+", "")
    inner = F.regexp_extract(m, r"^\(([a-z]+)\)$", 1)
    follows = (F.length(inner) == 1) & (F.ascii(inner) == F.ascii(F.coalesce(letter_before, F.lit(""))) + 1)
    kinds = F.when(m.rlike(r"^\(\d+\)$"), "num").when(inner.isin(SMALL_ROMANS) & ~follows, "roman").when(F.length(inner) == 1, "letter")
    return kinds.when(m.rlike(r"^\d+(\.\d+)+\.?$"), "decimal").when(m.rlike(r"^\d+\.$"), "paragraph").when(m.rlike("^[-–—•]$"), "dash").otherwise("other")


def layout_marker(line: Column) -> Column:
    """struct(kind, label, rest) of a line that opens with a marker two spaces in or more; kinds are tried in this order. Null for other lines."""
    # The patterns and their order.
    patterns = [
        ("decimal", r"^\s{2,}(\d+(?:\.\d+)+)\.?\s+([A-Z(‘].*)$"),
        ("paragraph", r"^\s{2,}(\d+)\.\s+(.*)$"),
        ("num", r"^\s{2,}\((\d+)\)\s+(.*)$"),
        ("roman", r"^\s{2,}\((i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)\)\s+(.*)$"),
        ("letter", r"^\s{2,}\(([a-z])\)\s+(.*)$"),
        ("dash", r"^\s{2,}(—)\s+(\S.*)$"),
    ]
    return F.coalesce(*(F.when(line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("label"), F.regexp_extract(line, p, 2).alias("rest"))) for kind, p in patterns))


def target_act(text: Column) -> Column:
    """The number of the first act that a text names, in the modern form or else the old one; null if there is none."""
    modern = F.regexp_extract(text, r"\((?:EU|EC|EEC)\)\s+(?:No\s+)?(\d+/\d+)", 1)
    return F.coalesce(F.nullif(modern, F.lit("")), F.nullif(F.regexp_extract(text, r"\b(\d{2,4}/\d+/(?:EC|EEC|EU))\b", 1), F.lit("")))


def version_id(version: Column, document: Column, digest: Column) -> Column:
    return F.coalesce(F.nullif(version, F.lit("")), F.concat(document, F.lit(":v-"), F.left(digest, F.lit(16))))


def topic_label(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def file_name(unit: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; each run of anything else is one underscore."""
    return F.concat(F.regexp_replace(unit, "[^A-Za-z0-9._-]+", "_"), F.lit(".json"))


def redacted(message: Column, texts: Column, secret: Column | None = None, most: int = 400) -> Column:
    """The first line of a message without source texts of 24 characters or more and without the secret, cut to `most` characters."""
    first = F.coalesce(F.nullif(F.regexp_extract(message, r"^([^\r\n]*)", 1), F.lit("")), F.lit("no details provided"))
    long = F.filter(texts, lambda t: F.length(t) >= 24)
    clean = F.aggregate(long, first, lambda m, t: F.replace(m, t, F.lit("[source text omitted]")))
    if secret is not None:
        clean = F.when(F.coalesce(secret, F.lit("")) == "", clean).otherwise(F.replace(clean, secret, F.lit("[credential omitted]")))
    return F.left(clean, F.lit(most))


def letter_spaced(line: Column) -> Column:
    """Whether a line set far in (20 spaces or more) has three words or more, of which seven in ten have four letters at most."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 4))
    return (F.length(line) - F.length(F.ltrim(line)) >= 20) & (F.size(words) >= 3) & (short * 10 >= F.size(words) * 7)
