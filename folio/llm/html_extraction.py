"""Main text of web pages by the consensus of their host.

1. Every page's containers are scored by the text of their paragraphs; each page votes for the generalised paths
   (tag and class, digits taken out) of its best containers.
2. Spark adds up the votes of each host; partial sums meet, so a host with a third of all pages is no hot group.
3. Every page is read again: its text is that of the elements on the best of its host's paths that gives a fair share
   of what its own best container has, or else of that container. Menus, adverts, comments and the like inside it are
   left out, but never what holds most of the page's text.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Containers a page votes for, paths kept of a host, and letters of hosts and paths up to which these are sent to all tasks.
VOTES, PATHS, BROADCAST_LETTERS = 3, 8, 16_000_000
SALTS = 32
#: Share of a page's text beside links above which an element is no clutter, whatever its name, and share of the text of the page's own best container that a path of the host must give.
MOST, FAIR = 2 / 3, 0.3

# Names of HTML and usual words of class names.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe svg math textarea title object canvas video audio".split())
_DROPPED = _RAW | set("head nav footer aside form button select dialog menu".split())
_BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption td th tr tbody table ul ol dl".split())
_KEPT = {"html", "body", "article", "main"}
_CLUTTER = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that beside a clutter word leave a class or id clutter; any other word does not, as in `with-sidebar` or `related-work`.
_PLAIN = set("area bar block body bottom box btn button buttons col column container content center form group head holder icon icons inner inline item items large left link links list main mobile outer page panel posts primary region right row secondary section site slot small sticky tags text title top unit wrap wrapper".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What may stand in head; anything else ends it.
_IN_HEAD = set("html head base link meta title script style noscript template".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: What the start of each of these ends, as far as it is open.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
#: One attribute, name and value; what a value or a longer name holds is never taken for another.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """A lenient tree of a page: for each node its parent, tag, path and whether it is clutter; and the texts in page order.

    A path is a number, told by the path above it and its last part, so memory grows with the nodes, however deep they lie.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.clutter, self.link, self.block = [-1], [""], [0], [False], [False], [0]
        #: The outermost `article` and `main` that holds a node, itself included, or 0.
        self.article, self.main = [0], [0]
        #: The innermost node that holds a node, itself included, and is no block of text.
        self.holder = [0]
        #: Number of a path by the number of the one above and its last part, and the same the other way round.
        self.numbers: dict[tuple[int, str], int] = {}
        self.parts: list[tuple[int, str]] = [(-1, "")]
        #: (node, text); text is a space where a block or a line ends.
        self.texts: list[tuple[int, str]] = []
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """clutter holds what each node is by itself; here it goes down the tree, but not from nodes with most of the text."""
        size = [0] * len(self.parent)
        for node, text in self.texts:
            if not self.link[node]:
                size[node] += len(text.strip())
        for node in range(len(size) - 1, 0, -1):
            size[self.parent[node]] += size[node]
        for node in range(1, len(size)):
            self.clutter[node] = self.clutter[self.parent[node]] or self.clutter[node] and size[node] <= MOST * size[0]
        self.texts = [(n, t) for n, t in self.texts if t == " " or not self.clutter[n]]

    def _read(self, source: str) -> None:
        open_nodes, at, end = [0], 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._text(open_nodes, source[at:])
                break
            if m.start() > at:
                self._text(open_nodes, source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if not m[1] and name not in _IN_HEAD:
                self._end_head(open_nodes)
            if name in _BLOCKS or name == "br":
                self.texts.append((open_nodes[-1], " "))
            if m[1]:
                self._close(open_nodes, name)
                continue
            self._imply(open_nodes, name)
            if name in _VOID:
                continue
            if name in _RAW:
                if m[3].endswith("/") and name in ("svg", "math"):
                    continue
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(source, at)
                at = end if close is None else source.find(">", close.end() - 1) + 1 or end
                continue
            open_nodes.append(self._node(open_nodes[-1], name, m[3]))

    def _end_head(self, open_nodes: list[int]) -> None:
        if self.tag[open_nodes[-1]] == "head":  # what may stand in it opens no node
            del open_nodes[-1]

    def _text(self, open_nodes: list[int], raw: str) -> None:
        if not raw.isspace():
            self._end_head(open_nodes)
        self.texts.append((open_nodes[-1], entities.unescape(raw) if "&" in raw else raw))

    def _close(self, open_nodes: list[int], name: str) -> None:
        for i in range(len(open_nodes) - 1, 0, -1):
            if self.tag[open_nodes[i]] == name:
                del open_nodes[i:]
                return

    def _imply(self, open_nodes: list[int], name: str) -> None:
        ended, scope = _IMPLIED.get(name), _SCOPE.get(name, ())
        if ended is None and name in _BLOCKS:
            ended, scope = {"p"}, _BLOCKS - {"p"}
        for i in range(len(open_nodes) - 1, 0, -1) if ended else ():
            tag = self.tag[open_nodes[i]]
            if tag in ended:
                del open_nodes[i:]
                if name != "tr":
                    return
            elif tag in scope:
                return

    def _node(self, parent: int, name: str, attributes: str) -> int:
        found: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), v.strip("\"'"))
        classes = found.get("class", "")
        tokens = [{p.lower() for p in _PART.findall(t)} for t in f"{classes} {found.get('id', '')}".split()]
        own = False
        if name not in _KEPT:
            named = name not in _HEADINGS and any(t & _CLUTTER and t <= _CLUTTER | _PLAIN for t in tokens)
            named = named and not (any("header" in t for t in tokens) and any(t & {"article", "post", "entry"} for t in tokens))
            own = name in _DROPPED or named or found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
            own = own or name == "header" and not self.article[parent]
        first = re.sub(r"[\d/]+", "", classes.split()[0].lower()) if classes.split() else ""
        node = len(self.parent)
        self.parent.append(parent)
        self.tag.append(name)
        part = (self.path[parent], f"{name}.{first}" if first else name)
        if part not in self.numbers:
            self.numbers[part] = len(self.parts)
            self.parts.append(part)
        self.path.append(self.numbers[part])
        self.article.append(self.article[parent] or (node if name == "article" else 0))
        self.holder.append(self.holder[parent] if name in _TEXT_BLOCKS else node)
        self.main.append(self.main[parent] or (node if name == "main" else 0))
        self.clutter.append(own)
        self.link.append(self.link[parent] or name == "a")
        self.block.append(node if name in _BLOCKS else self.block[parent])
        return node

    def _spelt(self, number: int) -> str:
        parts = []
        while number:
            number, part = self.parts[number]
            parts.append(part)
        return "".join(f"/{p}" for p in reversed(parts))

    def _number(self, path: str) -> int:
        """The number of a path, or 0 where the page has none such."""
        number = 0
        for part in path.split("/")[1:]:
            number = self.numbers.get((number, part), 0)
            if not number:
                break
        return number

    def containers(self, n: int) -> list[tuple[str, float]]:
        """Generalised paths of the n best containers and their scores, the best first, of equal ones that which comes first in the page. Text of paragraphs counts for what holds them, half for what holds that; links count against it."""
        score: dict[int, float] = {}
        for node, text in self.texts:
            length = len(text.strip())
            if not length or self.clutter[node]:
                continue
            worth = -float(length) if self.link[node] else float(length)
            holder = self.holder[self.block[node]]
            whole = self.article[holder] or self.main[holder]
            if whole:
                score[whole] = score.get(whole, 0) + 1.5 * worth
                continue
            score[holder] = score.get(holder, 0) + worth
            if (above := self.parent[holder]) > 0:
                score[above] = score.get(above, 0) + worth / 2
        by_path: dict[int, float] = {}
        for node, s in score.items():
            by_path[self.path[node]] = by_path.get(self.path[node], 0) + s
        best = heapq.nsmallest(n, ((-s, p) for p, s in by_path.items() if s > 0))
        return [(self._spelt(p), -s) for s, p in best]

    def on(self, path: str) -> str:
        """Text of all elements on the path; what is clutter inside them is left out."""
        number = self._number(path)
        if path and not number:
            return ""
        inside = [not path] * len(self.parent)
        for node in range(1, len(self.parent)):
            inside[node] = self.path[node] == number or inside[self.parent[node]]
        return " ".join("".join(t if inside[n] else " " for n, t in self.texts).split())

    def text(self, paths: list[str]) -> str:
        """Text on the first of the paths that gives a fair share of what the page's own best container has, or else of that container."""
        own = next((self.on(path) for path, _ in self.containers(1)), "")
        return next((found for found in map(self.on, paths) if found and len(found) >= FAIR * len(own)), own)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, path, vote = [], [], []
        for h, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            best = Page(source or "").containers(VOTES)
            total = sum(s for _, s in best)
            for p, s in best:
                host.append(h)
                path.append(p)
                vote.append(round(1000 * s / total))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(vote, pa.int64())], ["host", "path", "vote"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the generalised paths of each host with the most votes, the best first."""
    votes = pages.select("host", "html").mapInArrow(_voted, "host string, path string, vote long").where("host is not null")
    sums = votes.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    top = sums.withColumn("n", F.row_number().over(best)).where(F.col("n") <= PATHS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("paths"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist()):
            texts.append(Page(source or "").text(paths or []))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html counts as empty and gives an empty text, as does a page without any text outside clutter. A page
    whose url is null or names no host goes by its own best container. Rows are independent but for the votes of
    their host, so repeated rows and ids are kept. Other columns are not read.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    paths = written(host_paths(rows))
    letters = paths.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "")))).first()[0] or 0
    if letters <= BROADCAST_LETTERS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:  # a host's pages are dealt to SALTS groups
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    out = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_extracted, out)
