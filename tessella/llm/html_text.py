"""Operator 8, HTML extraction with site template removal.

Every page is parsed in its task to a tree of elements, in time linear in its length. First pass: each block container's
subtree is hashed together with the page's host, and Spark counts in how many different surroundings it stands. Second pass:
subtrees that recur on many pages of their host are deleted, and so are elements that are never main text by their kind; a name
says the same of an element only if it stands beside an article or does not hold half of the page's text. The blocks of what remains are joined. Pages of one host are never brought together: only hashes are
shuffled, summed on the map side first.

A surrounding is one of the longest texts of the page outside the subtree. A notice or menu stands beside another article on
every page; the part of an article that has been published again stands beside the same article, whatever advert it is
published with, and so is no template. What holds half of a page's text is no template there either.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, only, stored, table

# Fixed values of HTML: elements without content, with raw content, that are blocks, that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template svg math canvas object iframe button select textarea input dialog menu title audio video".split())
ASIDE = frozenset("nav footer aside form".split())  # as names
CONTAINERS = frozenset("div section ul ol dl table nav aside header footer form figure menu details center fieldset dialog".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "dd", "dt", "li", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
BOUNDS = frozenset("ul ol dl table select article section div body html td th blockquote".split())

# Parts of class names and ids of what is no main text; those of them that articles use for their own head; and
# parts that say no more than what kind of box it is.
_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social related recommend recommended recommendation recommendations comment comments commentlist disqus respond replies reply pagination pager widget widgets toolbar skiplink teaser teasers".split())
_HEADS = frozenset("header masthead".split())
_BOXES = frozenset("site page main global top bottom left right first last box bar block area wrapper wrap container content section list inner outer unit slot item items link links post posts article articles story stories text message row col column group panel primary secondary sticky fixed reader readers user users mobile desktop small large head body buttons button icons icon thread fb facebook google twitter this x".split())
_SURE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense disqus".split())  # whatever stands beside them
_COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
_COMMENT_HEADS = re.compile(r"(?:\d+\s+)?(?:reader |user |leser)?(?:comments?|replies|responses|kommentare?|comentarios?|commentaires?|leave a (?:comment|reply))(?:\s*\(?\d+\)?)?\W*", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_END_OF = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_LISTS = ("ul", "ol", "dl", "table", "select")


class Node:
    """An element: children are texts and nodes; first and last are the places, in document order, of the nodes it holds."""

    __slots__ = ("children", "drop", "first", "key", "last", "mass", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, drop: bool | None, first: int):
        self.tag, self.parent, self.drop, self.children, self.first, self.last, self.key, self.mass = tag, parent, drop, [], first, first, 0, 0


def parse(page: str) -> list[Node]:
    """The page's nodes in document order; the first is the root. Unclosed elements are closed where HTML closes them, or by
    their parent or the page's end; a tag that never ends is no text."""
    root = Node("#root", None, False, 0)
    nodes, stack, at, n = [root], [root], 0, len(page)
    open_: dict[str, list[int]] = {}  # by tag: the places in stack
    bounds: list[int] = []  # the places in stack of elements that an inner end tag doesn't close

    def place(*tags: str) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            open_[stack.pop().tag].pop()
        while bounds and bounds[-1] >= k:
            bounds.pop()

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            stack[-1].children.append(page[at:])
            break
        if mark > at:
            stack[-1].children.append(page[at:mark])
        at = mark + 1
        ending = page.startswith("/", at)
        name = _NAME.match(page, at + ending)
        if not name:
            if page.startswith("!--", at):
                end = page.find("-->", at + 1)
                at = n if end < 0 else end + 3
            elif page.startswith(("!", "?", "/"), at) and at + 1 < n:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                stack[-1].children.append("<")
            continue
        rest = _REST.match(page, name.end())
        if not rest:
            break
        at, tag = rest.end(), name[0].lower()
        top = bounds[-1] if bounds else 0
        if ending:
            k = place(tag)
            if k and (tag in BLOCKS or k >= top):
                close(k)
            continue
        if tag in CLOSES_P or tag == "p":
            k = place("p")
            if k > top:
                close(k)
        if tag in SIBLINGS:
            k = place(*SIBLINGS[tag])
            if k > place(*_LISTS):
                close(k)
        parent = stack[-1]
        told = _named(tag, rest[0]) if len(rest[0]) > 1 else False
        drop = True if tag in NEVER or told == "comments" else "named" if told or tag in ASIDE else None if told is None or tag == "header" else False
        node = Node(tag, parent, drop, len(nodes))
        nodes.append(node)
        parent.children.append(node)
        if tag in VOID or rest[0].endswith("/>") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = _END_OF[tag].search(page, at)
            if not end:
                break
            at = page.find(">", end.start()) + 1 or n
            continue
        open_.setdefault(tag, []).append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        stack.append(node)
    for node in nodes:
        if node.tag in _HEADINGS and node.parent.tag in CONTAINERS and next((x for x in node.parent.children if not isinstance(x, str) or not x.isspace()), None) is node:
            if _COMMENT_HEADS.fullmatch(" ".join(x for x in _texts(node)).strip()):
                node.parent.drop = True
    # A name decides about what stands beside an article, or does not hold half of the text that is left without the sure ones.
    held = [0] * len(nodes)
    for node in reversed(nodes):
        if node.drop is not True:
            held[node.first] = sum(len(x) - x.count(" ") if isinstance(x, str) else held[x.first] for x in node.children)
    for node in reversed(nodes):
        if node.parent:
            node.parent.last = max(node.parent.last, node.last)
    articles = [x for x in nodes if x.tag in ("article", "main") and x.drop is False and held[x.first]]
    ends, starts = min((x.last for x in articles), default=len(nodes)), max((x.first for x in articles), default=-1)
    inside = [False] * len(nodes)
    for node in nodes[1:]:
        up = node.parent
        inside[node.first] = up.tag in ("article", "main") or inside[up.first]
        named = node.drop == "named" or node.drop is None and not inside[node.first]
        beside = ends < node.first or starts > node.last
        node.drop = up.drop or node.drop is True or named and (beside or 2 * held[node.first] < held[0])
    return nodes


def _texts(node: Node) -> Iterator[str]:
    for x in node.children:
        if isinstance(x, str):
            yield x
        else:
            yield from (y for y in x.children if isinstance(y, str))


def _unwanted(value: str) -> bool | str | None:
    """Is one of the names of a class or id attribute one of no main text? Names count as wholes: all their parts must be known.
    None: only as the head of a site; "comments": what readers say."""
    found: bool | None = False
    for name in value.split():
        parts = [x for x in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
        hits = [x for x in parts if x in _NAMES]
        if hits and all(x in _NAMES or x in _BOXES for x in parts) and _COMMENTS & set(parts):
            return "comments"
        if parts[:1] and (parts[0] in _SURE or parts[-1] in _SURE):
            return True
        if hits and all(x in _NAMES or x in _BOXES for x in parts) or parts in (["sign", "up"], ["skip", "link"], ["side", "bar"]):
            if not hits or not all(x in _HEADS for x in hits) or {"site", "global"} & set(parts):
                return True
            if not {"post", "article", "story", "content", "section"} & set(parts):
                found = None
    return found


def _named(tag: str, attributes: str) -> bool | str | None:
    """Do the element's class, id or role say that it is no main text, or is it hidden? None: only outside an article."""
    found: bool | None = False
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and value and tag not in ("main", "body", "html"):
            told = _unwanted(value)
            if told:
                return told
            found = told if told is None else found
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return tag not in ("main", "body", "html")
    return found


def _keyed(nodes: list[Node]) -> None:
    """Sets each node's key, a digest of its subtree's tags and texts (0 without texts), and mass, the letters that it keeps."""
    digests: list = [b""] * len(nodes)
    for node in reversed(nodes):  # children come after their parents
        parts, filled = [node.tag.encode()], False
        for x in node.children:
            if isinstance(x, str):
                if x := " ".join(x.split()):
                    parts.append(b"t" + x.encode("utf-8", "surrogatepass"))
                    node.mass += len(x)
                    filled = True
            else:
                parts.append(digests[x.first])
                filled = filled or x.key != 0
                node.mass += x.mass
        digest = digests[node.first] = xxhash.xxh3_64_digest(b"\x00".join(parts))
        if filled:
            node.key = int.from_bytes(digest) | 1
        if node.drop:
            node.mass = 0


def _containers(nodes: list[Node]) -> list[Node]:
    """The containers that may be templates, whatever their names say: with text, and with less than half of what the page keeps."""
    return [x for x in nodes if x.key and x.tag in CONTAINERS and 2 * x.mass < nodes[0].mass]


def _signed(host: str, key: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(f"{host}\x00{key:x}")).astype(np.int64))


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _outermost(nodes: list[Node], tag: str, mass: list[int]) -> list[Node]:
    """The elements of a tag that are shown, hold text and stand in no other one of them."""
    found, end = [], 0
    for node in nodes:
        if node.tag == tag and not node.drop and node.first >= end and mass[node.first]:
            found.append(node)
            end = node.last + 1
    return found


def main_text(page: str | None, url: str | None = None, template: frozenset = frozenset()) -> str:
    """The main text of a page; template: keys of subtrees to delete. It is what the main elements hold; without any, what the
    articles hold if that is half of the text that stays, with titles of level 1 before their end; else the body."""
    if not page:
        return ""
    nodes = parse(page)
    _keyed(nodes)
    if template:
        host = _host(url)
        gone = [x for x in _containers(nodes) if _signed(host, x.key) in template]
        for x in gone:
            x.drop = True
    mass = [0] * len(nodes)
    for node in reversed(nodes):
        if not node.drop:
            mass[node.first] = sum(len(x) - x.count(" ") if isinstance(x, str) else mass[x.first] for x in node.children)
    outer = lambda tag: _outermost(nodes, tag, mass)
    tops = outer("main")
    if not tops:
        articles = outer("article")
        tops = nodes[:1]
        if 2 * sum(mass[x.first] for x in articles) >= mass[0] > 0:
            last = articles[-1].last
            tops = sorted([*articles, *(x for x in outer("h1") if x.first < last and not any(y.first < x.first <= y.last for y in articles))], key=lambda x: x.first)
    parts: list[str] = []
    for top in tops:
        todo: list = [iter(top.children)]
        ends = [" "]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
                parts.append(ends.pop())
            elif isinstance(x, str):
                parts.append(x)
            else:
                space = " " if x.drop or x.tag in BLOCKS else ""
                parts.append(space)
                if not x.drop:
                    todo.append(iter(x.children))
                    ends.append(space)
    return " ".join(html.unescape("".join(parts)).split())


def surroundings(page: str, url: str | None, most: int = 3) -> Iterator[tuple[int, int, int]]:
    """key, rank, sig for each container that may be a template: the page's longest texts outside it, by rank and digest, at
    most so many and none of less than a sixth of the longest. With no text outside, sig is 0."""
    nodes = parse(page)
    _keyed(nodes)
    texts = sorted((x.first, k, t) for x in nodes if x.key and not x.drop for k, t in enumerate(x.children) if isinstance(t, str) and not t.isspace())
    order = lambda y: (-len(y[2]), y[0], y[1])

    def longest(some: list) -> tuple[list[int], list[list]]:
        """The longest texts of each beginning of the list, and the places of their elements."""
        best, held = [[]], []
        for y in some:
            held = sorted([*held, y], key=order)[:most]
            best.append(held)
        return [y[0] for y in some], best

    at, before = longest(texts)
    _, after = longest(texts[::-1])
    host = _host(url)
    for x in _containers(nodes):
        outside = sorted([*before[bisect_left(at, x.first)], *after[len(texts) - bisect_right(at, x.last)]], key=order)[:most]
        for rank, (_, _, t) in enumerate(outside):
            if 6 * len(t) < len(outside[0][2]):
                break
            yield _signed(host, x.key), rank, xxhash.xxh3_64_intdigest(" ".join(t.split()).encode("utf-8", "surrogatepass")) >> 1
        if not outside:
            yield _signed(host, x.key), 0, 0


def template_keys(pages: DataFrame, *, min_pages: int = 5) -> DataFrame:
    """key long: hashes of (host, subtree) for block containers that stand in min_pages different surroundings on their host or
    more, however many pages the host has. Copies of a page, under whatever address, are one surrounding."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            found = [x for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if page for x in set(surroundings(page, url))]
            keys, ranks, sigs = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ranks, pa.int8()), pa.array(sigs, pa.int64())], names=["key", "rank", "sig"])

    places = only(pages, "url", "html").mapInArrow(subtrees, "key long, rank byte, sig long").distinct()
    return places.groupBy("key", "rank").count().filter(F.col("count") >= min_pages).select("key").distinct()


def extract_text(pages: DataFrame, *, min_pages: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    Null and empty html give an empty text; a null url counts as a host without a name. Rows are handled one by one, so
    repeated rows give repeated results. The template keys are broadcast while they are at most broadcast_rows (8 bytes each);
    beyond, pages get their own keys by a join on the keys."""
    keys = stored(template_keys(bounded_batches(pages), min_pages=min_pages))
    rows = only(pages, "page_id", "url", "html")
    if keys.count() <= broadcast_rows:
        known = pages.sparkSession.sparkContext.broadcast(frozenset(r["key"] for r in keys.collect()))
        rows = rows.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        known = None
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in lean(batches):
                ids, out = [], []
                for one, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if page:
                        _keyed(nodes := parse(page))
                        for key in {_signed(_host(url), x.key) for x in _containers(nodes)}:
                            ids.append(one), out.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["row", "key"])

        met = rows.select("row", "url", "html").mapInArrow(own, "row long, key long").join(keys.hint("shuffle_merge"), "key")
        rows = rows.join(met.groupBy("row").agg(F.collect_set("key").alias("keys")).hint("shuffle_merge"), "row", "left").drop("row")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out = [main_text(page, url, known.value if known else frozenset(keys or ())) for url, page, keys in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
