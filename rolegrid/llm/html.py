"""Main text of web pages: site templates go by counting equal subtrees of a host, page furniture by its kind.

A page is parsed into a tree. Every container outside plain prose is hashed with all that is below it; Spark counts,
for each host, on how many different pages (by main text) each hash occurs. Containers that recur on ``min_pages``
of them at least are template and go, as do menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, which are known by their element or by a name in their class, id or role that has a furniture
word and no word of state (sidebar-left is one, with-sidebar and comments-open are not). Names of main and body say
nothing, an article goes only by a whole name, and what lies around the main part counts by name only if a main part is
left then; a header with a heading inside the main part stays. What is left of the articles (or of the main part, or of the body, if the page has none) is the text: references decoded, white
space inside a block made one space, blocks in page order joined by one space.

A container that is an article, main or body, or lies around one, is never a template; nor is prose (paragraphs,
headings, list items, quotes), so a sentence that many articles share stays.

Defined results: null and empty html give an empty text; a null or hostless url is a host of its own; repeated rows
share a result; unclosed and misnested elements are closed where a browser would; broken markup of megabytes is read in
linear time, a tag that never ends is text, a quote that never ends an ordinary character; an empty table gives an empty
table. Columns beyond the named ones are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_batches, staged

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
#: A tag without angle brackets in its attributes; all others take the way of ``TagEnds``.
PLAIN_TAG = re.compile(TAG.pattern + r"((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that end an open paragraph when they start.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element that starts ends an open one of these, up to the given borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FURNITURE = frozenset("nav header footer aside form script style noscript template svg iframe button select textarea dialog menu head title object embed canvas audio video input".split())
#: Words of a class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup sidebar menu navbar nav navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus respond share sharing social related recommended widget "
    "popup modal overlay login paywall pagination pager toolbar skip complementary contentinfo search".split()
)
#: Words that say how a page is laid out (with-sidebar, comments-open), not what an element is.
STATES = frozenset("with has have no not without is open opened closed enabled disabled on off allowed count".split())
MAIN = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead figcaption".split())


class Element:
    __slots__ = ("tag", "attributes", "children", "mark")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.mark: str | None = None

    def furniture(self, named: bool = True) -> bool:
        """Page furniture by element or, if ``named``, by class, id and role: a name with a furniture word and no word of state.
        An article is one only if a whole name says so; main and body never are."""
        if self.tag in FURNITURE:
            return True
        if not self.attributes or self.tag in ("main", "body", "html"):
            return False
        for name, value in ATTRIBUTE.findall(self.attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True
            if named and name in ("class", "id", "role"):
                for token in value.split():
                    words = [token] if self.tag == "article" else re.split(r"[^a-z0-9]+", token)
                    if not MARKS.isdisjoint(words) and STATES.isdisjoint(words):
                        return True
        return False


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes; a quote that is never closed is an ordinary character. What was found for
    one position is kept, so that broken markup is scanned once."""

    def __init__(self, source: str):
        self.source, self.last = source, {c: source.rfind(c) for c in ">\"'"}
        self.known: dict[int, int] = {}
        self.span = (0, -1)

    def special(self, at: int) -> int:
        """The next ``>`` or quote from ``at`` on, or -1."""
        if not self.span[0] <= at <= self.span[1]:
            found = SPECIAL.search(self.source, at)
            self.span = (at, found.start() if found else len(self.source))
        return self.span[1] if self.span[1] < len(self.source) else -1

    def after(self, at: int) -> int:
        """The end of the tag whose attributes start at ``at``, or -1."""
        seen, end = [], -1
        while at <= self.last[">"]:
            p = self.special(at)
            if p < 0 or p in self.known:
                end = self.known.get(p, -1)
                break
            seen.append(p)
            sign = self.source[p]
            if sign == ">":
                end = p
                break
            at = (self.source.find(sign, p + 1) if p < self.last[sign] else p) + 1
        self.known.update(dict.fromkeys(seen, end))
        return end


def parse(source: str) -> Element:
    """A tree of elements and texts (as they stand, references not decoded)."""
    root, ends = Element("", ""), TagEnds(source)
    stack, at, end = [root], 0, len(source)
    open_: dict[str, int] = {}

    def close(tags: set[str] | frozenset[str], borders: set[str] | frozenset[str]) -> None:
        for t in tags:
            if open_.get(t):
                break
        else:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for e in stack[i:]:
                    open_[e.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in borders:
                return

    while at < end:
        low = source.find("<", at)
        if low < 0:
            stack[-1].children.append(source[at:])
            break
        if low > at:
            stack[-1].children.append(source[at:low])
        found = PLAIN_TAG.match(source, low)
        if found:
            at, name, attributes = found.end(), found[2], found[3]
        else:
            if low > ends.last[">"] and not source.startswith("<!--", low):
                stack[-1].children.append(source[low:])
                break
            found = COMMENT.match(source, low)
            if found:
                at = found.end()
                continue
            found = TAG.match(source, low)
            stop = ends.after(found.end()) if found else -1
            if stop < 0:
                stack[-1].children.append("<")
                at = low + 1
                continue
            at, name, attributes = stop + 1, found[2], source[found.end() : stop]
        tag = name.lower()
        if found[1]:
            if tag == "br" or tag == "p" and not open_.get("p"):
                stack[-1].children.append(Element(tag, ""))
            elif tag not in VOID:
                close({tag}, frozenset() if tag not in INLINE else PROSE | ENDS_PARAGRAPH)
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"button", "table", "td", "th", "li", "article", "section", "div"})
        if tag in ENDS:
            close(*ENDS[tag])
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        if tag in RAW:
            close_ = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            element.children.append(source[at : close_.start() if close_ else end])
            at = end if close_ is None else (source.find(">", close_.start()) + 1 or end)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def walk(element: Element) -> Iterator[Element]:
    todo = [element]
    while todo:
        now = todo.pop()
        yield now
        todo.extend(c for c in reversed(now.children) if not isinstance(c, str))


def mark(root: Element) -> None:
    """Hash every subtree that could be template: containers that are neither prose nor inline, nor hold the main part."""
    order = list(walk(root))
    holds_main: set[int] = set()
    for element in reversed(order):
        if element.tag in MAIN or any(id(c) in holds_main for c in element.children):
            holds_main.add(id(element))
    digests: dict[int, bytes] = {}
    for element in reversed(order):
        state = hashlib.blake2b(f"<{element.tag} {SPACE.sub(' ', element.attributes).strip()}>".encode("utf-8", "replace"), digest_size=12)
        for child in element.children:
            if isinstance(child, str):
                state.update(b"t" + SPACE.sub(" ", child).strip().encode("utf-8", "replace"))
            else:
                state.update(b"e" + digests[id(child)])
        digests[id(element)] = state.digest()
        if id(element) not in holds_main and element.tag not in PROSE and element.tag not in INLINE and element.tag not in VOID and element.tag not in ("", "html", "body"):
            element.mark = digests[id(element)].hex()


def main_text(root: Element, template: set[str] | frozenset[str] = frozenset()) -> str:
    """Text of the main part without furniture and without the subtrees whose hash is in ``template``."""
    def gone(e: Element, named: bool = True) -> bool:
        if e.tag == "header" and e.mark not in template and any(c.tag in HEADINGS for c in walk(e)):
            return not in_main
        return e.furniture(named) or e.mark in template

    def parts(tag: str, named: bool = True) -> list[Element]:
        """The outermost elements of a kind that are not inside furniture."""
        out, todo = [], [root]
        while todo:
            now = todo.pop()
            if now.tag == tag:
                out.append(now)
            elif now.tag in ("", "html", "body") or not gone(now, named):
                todo.extend(c for c in reversed(now.children) if not isinstance(c, str))
        return [e for e in out if tag == "body" or not gone(e, named)]

    # what lies around the main part is furniture by its name only as long as that leaves a main part
    in_main = False
    tops = parts("article") or parts("main") or parts("article", False) or parts("main", False)
    in_main = bool(tops)
    tops = tops or parts("body") or [root]
    blocks: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            blocks.append(text)

    for top in tops:
        todo: list = [top]
        while todo:
            now = todo.pop()
            if now is None:
                flush()
            elif isinstance(now, str):
                pieces.append(now)
            elif now.tag == "br":
                pieces.append(" ")
            elif now is top or not gone(now):
                block = now.tag not in INLINE
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(now.children))
        flush()
    return " ".join(blocks)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame, min_pages: int = 10, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text``.

    The first pass writes, for each page, its host, the hashes of its containers and a hash of its main text; hashes
    are counted by host; pages that hold a recurring one get the list of theirs by a join before the second pass.
    """
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(url).alias("host"))
    keyed = narrow.withColumns({"key_a": F.xxhash64("page_id", "url"), "key_b": F.xxhash64("html")})

    def marks(batch: pa.RecordBatch):
        out: tuple[list, ...] = ([], [], [], [], [])
        for a, b, host, text in zip(*(c.to_pylist() for c in batch.columns)):
            root = parse(text or "")
            mark(root)
            main = hashlib.blake2b(main_text(root).encode("utf-8", "replace"), digest_size=12).hexdigest()
            for m in {e.mark for e in walk(root) if e.mark and e.tag not in ("script", "style", "title", "head", "meta")}:
                for column, x in zip(out, (a, b, host, m, main)):
                    column.append(x)
        return out

    seen = staged(map_batches(keyed.select("key_a", "key_b", "host", "html"), marks, "key_a bigint, key_b bigint, host string, mark string, main string"), "subtrees")
    template = seen.groupBy("host", "mark", "main").agg(F.lit(1).alias("one")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = staged(template.select("host", "mark"), "templates")
    hit = seen.join(template, ["host", "mark"], "left_semi").groupBy("key_a", "key_b").agg(F.collect_set("mark").alias("marks"))

    def cut(batch: pa.RecordBatch):
        out = []
        for text, marked in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            root = parse(text or "")
            if marked:
                mark(root)
            out.append(main_text(root, frozenset(marked or ())))
        return [batch.column(0), batch.column(1), out]

    kind = f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string"
    joined = keyed.join(hit, ["key_a", "key_b"], "left").select("page_id", "url", "html", "marks")
    return map_batches(joined, cut, kind)
