"""Main text of web pages by consensus of a host's pages.

1. Each page is parsed leniently and its containers are scored: paragraphs give points for length and commas to
   their parent and half to its parent, less the share of linked text. The best one, with the article around it and
   its heading, names a path of tags and classes in which digits are generalised.
2. Spark counts the votes for every path of a host (a grouped count, small rows).
3. Each page is parsed again and its text is taken from the elements on the path with most votes that it has; without any,
   from its own best container, and at last from the body. No path is dropped: a small table of votes goes to the pages, and
   with a large one each page asks for the votes of its own paths.

Inside of what is chosen, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out, told by tag, role, class or id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm.store import small_batches, written
from probelens.llm.words import slices

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element that its own kind (and these) ends, up to one of the last.
ENDED_BY_NEXT = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of a text.
LEFT_OUT = RAW | frozenset("nav footer aside form button select noscript template svg canvas object audio video head dialog menu math input".split())
LEFT_OUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class or id that tell what isn't the article.
LEFT_OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottombar sidebar aside rail widget widgets ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations more-stories "
    "comment comments commentlist respond disqus reply replies breadcrumb breadcrumbs pagination pager skip toolbar search form byline-share copyright legal disclaimer".split()
)
#: Of these, ones that also name parts of an article (with a word for it beside), and wrappers of whole pages.
OF_ARTICLES = frozenset("header masthead banner legal notice".split())
ARTICLE_WORDS = frozenset("article story entry post".split())
OF_LAYOUTS = frozenset("sidebar header footer nav navbar menu banner rail overlay modal aside widget widgets search cookie cookies consent".split())
GOOD_WORDS = frozenset("article content main post entry story text body page blog".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)  # fmt: skip
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+")
_END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Element:
    __slots__ = ("tag", "label", "words", "parent", "inside", "out", "layout", "of_article")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.inside = tag, parent, []
        self.of_article = parent is not None and (parent.of_article or parent.tag in ("article", "main"))
        found = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(attributes)} if attributes else {}
        classes, name = found.get("class", "").lower().split(), found.get("id", "").lower()
        self.label = tag + "".join("." + c for c in sorted(re.sub(r"\d+", "#", x) for x in classes)) + ("#" + re.sub(r"\d+", "#", name) if name else "")
        self.words = {w for x in (*classes, name) for part in (x, *re.split(r"[-_:]", x)) for w in (part, *_WORD.findall(part))}
        role = found.get("role", "").lower()
        told = set() if tag in ("html", "body", "article", "main") else self.words & LEFT_OUT_WORDS
        if self.words & ARTICLE_WORDS:
            told -= OF_ARTICLES
        self.layout = bool(told) and told <= OF_LAYOUTS and tag not in LEFT_OUT and role not in LEFT_OUT_ROLES and "hidden" not in found
        self.out = tag in LEFT_OUT or role in LEFT_OUT_ROLES or "hidden" in found or bool(told)
        if tag == "header":  # a page's header goes; an article's keeps its headings (see Page)
            self.out = not self.of_article

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def path(self) -> str:
        return "/".join([e.label for e in [self, *self.ancestors()]][::-1])


def parse(html: str) -> Element:
    """A tree of elements; `inside` holds text and elements in order."""
    root = Element("", "", None)
    stack, at, end = [root], 0, len(html)
    while at < end:
        lt = html.find("<", at)
        found = _TAG.match(html, lt) if lt >= 0 else None
        if lt < 0:
            stack[-1].inside.append(html[at:])
            break
        if lt > at:
            stack[-1].inside.append(html[at:lt])
        if found is None:
            stack[-1].inside.append("<")
            at = lt + 1
            continue
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                stack[-1].inside.append(found[0][9:].removesuffix("]]>"))
            continue
        if found[5] and not found[0].endswith(">"):
            break  # the page ends in a tag
        if found[1] or found[4]:
            _end(stack, tag)
            continue
        _make_room(stack, tag)
        element = Element(tag, found[3] or found[6] or "", stack[-1])
        stack[-1].inside.append(element)
        if tag in RAW:
            close = _END_OF_RAW[tag].search(html, at)
            at = close.end() if close else end
        elif tag not in VOID:
            stack.append(element)
    return root


def _make_room(stack: list[Element], tag: str) -> None:
    """End the elements that the start of this one ends."""
    if tag in CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag not in INLINE:
                break
    if tag in HEADINGS and stack[-1].tag in HEADINGS:
        stack.pop()
    if tag in ENDED_BY_NEXT:
        own, limit = ENDED_BY_NEXT[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in limit:
                break
            if stack[i].tag in own:
                del stack[i:]
                if tag not in ("tr", "tbody", "tfoot"):
                    break


def _end(stack: list[Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in INLINE and stack[i].tag not in INLINE:
            return  # misnested; the block goes on


class Page:
    """A parsed page and the text its elements hold."""

    def __init__(self, html: str):
        self.root = parse(html)
        elements = list(self.walk(self.root, all_=True))
        self.body = next((e for e in elements if e.tag == "body"), self.root)
        for e in self.around(e for e in elements if e.tag in ("article", "main")):
            if e.layout:  # a page's wrapper may be named after its sidebar
                e.out = False

    @staticmethod
    def around(some: Iterable[Element]) -> list[Element]:
        """Some elements and all elements they are in, each once."""
        seen: dict[int, Element] = {}
        for e in some:
            for a in (e, *e.ancestors()):
                if id(a) in seen:
                    break
                seen[id(a)] = a
        return list(seen.values())

    @staticmethod
    def walk(top: Element, all_: bool = False) -> Iterator[Element]:
        stack = [top]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(x for x in reversed(e.inside) if not isinstance(x, str) and (all_ or not x.out))

    @staticmethod
    def text(top: Element) -> list[str]:
        """The blocks of an element in page order, without what is left out."""
        blocks, run = [], []

        def flush() -> None:
            if block := " ".join(unescape("".join(run)).split()):
                blocks.append(block)
            run.clear()

        todo: list = [(top, False)]
        while todo:
            x, after = todo.pop()
            if isinstance(x, str):
                run.append(x)
            elif after:
                flush()
            elif x.out and x is not top:
                if x.tag not in INLINE:
                    flush()
            elif x.tag == "br" or x.tag in ("td", "th"):
                run.append(" ")
                todo.extend((y, False) for y in reversed(x.inside))
            else:
                if x.tag not in INLINE and x.tag not in VOID or x.tag == "hr":
                    flush()
                    todo.append((x, True))
                inside = x.inside
                if x.tag == "header":
                    inside = [e for e in Page.walk(x) if e.tag in HEADINGS]
                todo.extend((y, False) for y in reversed(inside))
        flush()
        return blocks

    def best(self) -> Element | None:
        """The container with the highest score, with the article around it and its heading."""
        points: dict[int, float] = {}
        seen: dict[int, Element] = {}
        for e in self.walk(self.body):
            if e.tag not in ("p", "pre", "td", "blockquote", "li", "div", "section", "article", "main", "body", ""):
                continue
            own = [x for x in e.inside if isinstance(x, str) or x.tag in INLINE and not x.out]
            length = commas = links = 0
            for x in own:
                for s, linked in _strings(x):
                    n = len(s.strip())
                    length, commas, links = length + n, commas + s.count(","), links + n * linked
            if length < 25:
                continue
            score = (1 + commas + min(length / 100, 3)) * (1 - links / length)
            holder = e if e.tag in ("div", "section", "article", "main", "body", "") else e.parent
            for k, c in enumerate((holder, holder.parent if holder else None)):
                if c is not None and (c is self.body or c is not self.root):
                    seen[id(c)] = c
                    points[id(c)] = points.get(id(c), 0.0) + score / (k + 1)
        if not seen:
            return None
        weight = lambda c: points[id(c)] * (1.25 if c.words & GOOD_WORDS or c.tag in ("article", "main") else 1)
        top = max(seen.values(), key=weight)
        for tag in ("article", "main"):
            outer = next((a for a in [top, *top.ancestors()] if a.tag == tag), None)
            if outer is not None:
                return outer
        titled = {id(e) for e in self.around(x for x in self.walk(self.root) if x.tag == "h1")}
        if id(top) not in titled:
            for outer in top.ancestors():
                if outer is self.root or outer.out:
                    break
                if id(outer) in titled:
                    return outer
                if outer is self.body:
                    break
        return top

    @cached_property
    def by_key(self) -> dict[int, list[tuple[int, Element]]]:
        """(depth, element) of all elements in page order, by the hash of their path (see `key_of`), made from their parent's."""
        out: dict[int, list[tuple[int, Element]]] = {}
        stack = [(self.root, _hasher(), 0)]
        while stack:
            e, made, depth = stack.pop()
            out.setdefault(_number(made), []).append((depth, e))
            for x in reversed(e.inside):
                if not isinstance(x, str) and not x.out:
                    of_x = made.copy()
                    of_x.update(f"/{x.label}".encode("utf-8", "replace"))
                    stack.append((x, of_x, depth + 1))
        return out

    def at(self, path: str) -> list[Element]:
        """Outermost elements on a path. Only classes with a slash in them give one path to elements of different depths."""
        found = self.by_key.get(key_of(path), [])
        if len({depth for depth, _ in found}) < 2:
            return [e for _, e in found]
        inner = {id(e) for _, e in found}
        return [e for _, e in found if not any(id(a) in inner for a in e.ancestors())]


def _strings(x: str | Element, linked: bool = False) -> Iterator[tuple[str, bool]]:
    if isinstance(x, str):
        yield x, linked
        return
    todo = [(x, linked)]
    while todo:
        e, link = todo.pop()
        if isinstance(e, str):
            yield e, link
        elif not e.out:
            todo.extend((y, link or e.tag == "a") for y in e.inside)


def _hasher():
    return hashlib.blake2b(digest_size=8)


def _number(made) -> int:
    return int.from_bytes(made.digest(), "little", signed=True)


def key_of(path: str) -> int:
    made = _hasher()
    made.update(path.encode("utf-8", "replace"))
    return _number(made)


def main_path(html: str) -> str | None:
    best = Page(html).best()
    return best.path() if best is not None else None


def main_text(html: str, paths: list[str], votes: dict[int, tuple[int, str]] | None = None) -> str:
    """The text of a page by the first path that it has: of `paths`, or of those in `votes`, (less votes, path) by key."""
    page = Page(html)
    if votes:
        paths = [path for _, path in sorted(votes[k] for k in page.by_key.keys() & votes.keys())]
    for path in paths:
        if blocks := [b for e in page.at(path) for b in page.text(e)]:
            return "\n".join(blocks)
    best = page.best()
    return "\n".join(page.text(best if best is not None else page.body))


def host_of(url):
    """The host of a url in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, key, path, votes): all paths that pages of a host voted for."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_path(h) if h else None for h in batch.column("html").to_pylist()]
            keys = [key_of(p) if p is not None else None for p in found]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.int64()), pa.array(found, pa.string())], names=["host", "key", "path"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    votes = rows.mapInArrow(vote, "host STRING, key BIGINT, path STRING").where("path IS NOT NULL")
    return votes.groupBy("host", "key", "path").agg(F.count(F.lit(1)).alias("votes"))


#: Bytes of all votes that are sent to every task, and places the votes for a path go to where there are more.
SMALL, SALTS = 8 << 20, 32


def _with_paths(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Every page with those of its paths that have votes, most votes first, ties by path. Pages send hashes of their paths,
    to SALTS places for each path, so that a path of a hot host is no task; what is found is joined to the page's row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            keys = [sorted(Page(h).by_key) if h else [] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("row"), pa.array(keys, pa.list_(pa.int64()))], names=["host", "row", "keys"])

    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    asked = rows.select("host", "row", "html").mapInArrow(ask, "host STRING, row BIGINT, keys ARRAY<BIGINT>")
    asked = asked.select("host", "row", F.explode("keys").alias("key")).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    salted = votes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = asked.join(salted, ["host", "key", "salt"]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct((-F.col("votes")).alias("less"), "path"))).alias("found"))
    return rows.join(found.select("row", F.transform("found", lambda x: x["path"]).alias("paths")), "row", "left")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page, blocks joined by a line feed.

    Null or empty html gives an empty text, html without tags its own text. Pages without a host vote together.
    Repeated rows vote as often as they occur. Other columns are ignored.
    """
    small_batches(pages.sparkSession, 500)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    votes = written(votes_of(pages, url, html), "votes")
    size = votes.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    by_host: dict[str, dict] | None = None
    if size <= SMALL:
        by_host = {}
        for r in votes.collect():
            by_host.setdefault(r.host, {})[r.key] = (-r.votes, r.path)
    known = rows.withColumn("paths", F.lit(None).cast("array<string>")) if by_host is not None else _with_paths(rows, votes)
    shared = pages.sparkSession.sparkContext.broadcast(by_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value or {}
        for batch in slices(batches, "html"):
            columns = (batch.column(n).to_pylist() for n in ("html", "host", "paths"))
            texts = [main_text(h, paths or [], of.get(host)) if h else "" for h, host, paths in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    known = known.select("page_id", "url", "html", "host", "paths")
    return known.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text STRING")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
