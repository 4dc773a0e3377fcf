"""Main text of web pages by tree scoring.

A page is read into a light tree (void elements, raw text and implied ends as browsers treat them). Page furniture goes
first, unless it holds the article: elements that are navigation, footers, sidebars, forms, scripts and the like by
their tag, or hidden, or by their role. A class or id alone removes an element only if the whole name says so (each of
its words names furniture or a place or shape, as in "cookie-notice" or "ad_slot") and its size agrees: it has at most
half of the text of the article or page around it, or mostly links, or there are paragraphs or headings beside it. A name that merely has such a word among others ("ad-free", "content-bottom", "legal-analysis") takes a quarter of the points
of the element, and removes it only if it is mostly links.

Every paragraph then passes points to its ancestors: one, one for each comma and one for each hundred characters up to
three; the parent gets all, the grandparent half, those above a third of that by level. A container's points are
discounted by its link density. The best container is kept (of equal ones the first of the page); where it lies in an
<article> (or <main>), that element is. Of its siblings, headings and those with a fifth of its points or with paragraphs
of their own and few links are kept too.

Text: character references are decoded, white space inside a block is one space, blocks are trimmed and joined in page
order by two line feeds. Nothing is cut off, and very long or deep pages are read whole without recursion.

Nulls: a null page is empty, and its text is empty; a null page_id or url stays null. Repeated rows are kept. An empty
table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of the HTML standard, and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body option optgroup legend".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = frozenset("table td th ul ol dl body html article section div".split())
DROPPED = frozenset("head script style noscript template iframe svg math canvas object embed audio video nav footer aside form button select input textarea dialog menu fieldset label noembed noframes map progress meter datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
COMMENTS = frozenset("comment comments commentlist commentary disqus respond replies".split())
FURNITURE = COMMENTS | frozenset(
    "nav navbar navigation menu submenu topnav header masthead topbar footer sitefooter sidebar cookie cookies consent gdpr notice notices banner paywall promo promoted "
    "promotion sponsor sponsors sponsored advert adverts advertisement advertising ad ads adsense adbox adslot share sharing social breadcrumb breadcrumbs pagination pager "
    "paging newsletter subscribe subscription signup login register search searchbox popup modal overlay widget toolbar copyright hidden disclaimer skip".split()
)
#: Words that name furniture only sometimes: a name of such alone is a name among others.
MILD = frozenset("side bottom rail aside alert warning reply discussion related recommended tags taglist legal toc".split())
#: Words that say where or in what shape something is.
NEUTRAL = MILD | frozenset(
    "site page global top left right main primary secondary first last inner outer container wrapper wrap box bar list links link block section area unit slot item items button "
    "buttons icon icons panel group row col column mobile desktop sticky fixed form text message title heading posts articles content bottom feed thread js the and by of".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HEADINGS = frozenset(("h1", "h2", "h3"))
PARAS = HEADINGS | frozenset("p pre blockquote li dd".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "drop", "holds", "linked", "mild", "paras", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, drop: bool | str = False):
        self.mild = drop == "mild"
        self.tag, self.parent, self.drop = tag, parent, drop
        self.children: list[Node | str] = []
        self.points = 0.0
        self.holds = False
        self.size = self.linked = 0


def furniture(tag: str, attributes: str) -> bool | str:
    """What the attributes say of an element: True if it is no part of an article, else "comment", "header", "named" or "mild"."""
    if not attributes or attributes.isspace():
        return False
    said: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "p", "h1"):
            for part in value.split():  # "has-sidebar" speaks of another element
                ws = [w.lower() for w in WORDS.findall(part)]
                if not ws or ws[0] in ("has", "with", "no", "without", "not"):
                    continue
                named = [w for w in ws if w in FURNITURE]
                if named and all(w in FURNITURE or w in NEUTRAL for w in ws):
                    said.add("comment" if any(w in COMMENTS for w in named) else "header" if set(named) == {"header"} else "named")
                elif named or any(w in MILD for w in ws):
                    said.add("mild")
    if tag == "article":
        return "comment" if "comment" in said else False
    return next((x for x in ("comment", "named", "header", "mild") if x in said), False)


def parse(page: str) -> Node:
    root = node = Node("#root", None)
    at, find = 0, TAG.search
    while m := find(page, at):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in ENDS_P or tag in IMPLIED:
            up = node
            while up is not root and up.tag not in SCOPE and up.tag != "p" and up.tag not in IMPLIED.get(tag, ()):
                up = up.parent
            if up.tag == "p" and tag in ENDS_P:
                node = up.parent
        if tag in IMPLIED:
            up, ends = node, IMPLIED[tag]
            stop = ("table", "#root") if tag in ("tr", "td", "th", "tbody", "tfoot") else ("ul", "ol", "dl", "menu", "select", "#root")
            last = None
            while up.tag not in stop:
                if up.tag in ends:
                    last = up
                up = up.parent
                if up is None:
                    break
            if last is not None:
                node = last.parent
        new = Node(tag, node, tag in DROPPED or furniture(tag, m[3]))
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            if tag == "xmp":
                new.children.append(inner)
        elif tag not in VOID and not m[3].endswith("/"):
            node = new
        elif tag not in VOID:
            node = new if tag in BLOCKS else node
    if at < len(page):
        node.children.append(page[at:])
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, parents before children, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if type(c) is Node)
    return out


def measure(nodes: list[Node]) -> None:
    """Text, linked text and text of paragraphs of each element, parents before children, without what is dropped."""
    for n in nodes:
        n.size = n.linked = n.paras = 0
    for n in reversed(nodes):
        n.size += sum(len(c.strip()) for c in n.children if type(c) is str)
        if n.tag == "a":
            n.linked = n.size
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.linked += n.linked
            n.parent.paras += n.size - n.linked if n.tag in PARAS else n.paras


def score(root: Node) -> list[Node]:
    """Elements that stay, with their points, text sizes and linked text sizes."""
    nodes = _walk(root)
    for n in reversed(nodes):
        n.holds = n.tag in ("article", "main") and not n.drop or any(c.holds for c in n.children if type(c) is Node)
    sure: list[Node] = []
    inside: dict[int, Node] = {}  # the article, main or page around each element
    for n in nodes:
        around = inside.get(id(n.parent), root)
        inside[id(n)] = n if n.tag in ("article", "main") and not n.drop else around
        if n.parent is not None:
            if n.tag == "header" and n.drop in (False, "mild"):
                n.drop = "header"
            n.drop = True if n.parent.drop is True else n.drop is True and (not n.holds or n.tag in ("head", "noscript", "template")) or (n.drop if type(n.drop) is str else False)
        if n.drop is not True:
            sure.append(n)
    measure(sure)
    kept = []
    for n in sure:
        if n.parent is not None and n.drop:
            around, links = inside[id(n.parent)], 2 * n.linked >= n.size
            if n.parent.drop:
                n.drop = True
            elif n.holds or n.drop == "mild" and not links:
                n.drop = False
            elif n.drop == "header" and around is not root:  # an article's own header holds its title
                n.drop = False
            else:  # unless it has the paragraphs of the article or page
                n.drop = links or 2 * n.size <= around.size or around.paras > n.paras
        elif n.parent is not None:
            n.drop = n.parent.drop
        if not n.drop:
            kept.append(n)
    measure(kept)
    for n in kept:
        direct = n.tag in ("div", "section", "article", "main", "td", "body", "center") and any(type(c) is str and len(c.strip()) >= 25 for c in n.children)
        if n.tag not in ("p", "pre", "blockquote", "li", "dd") and not direct or not n.size:
            continue
        commas = sum(c.count(",") for c in n.children if type(c) is str)
        points = (1 + commas + min(n.size / 100, 3)) * (1 - n.linked / n.size)
        up, level = (n if direct else n.parent), 0
        while up is not None and up.tag != "#root":
            up.points += points / (1 if not level else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for n in kept:
        if n.mild:
            n.points *= 0.75
    return kept


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := SPACE.sub(" ", html.unescape("".join(run))).strip():
                out.append(text)
            run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif type(n) is str:
            run.append(n)
        elif n.drop:
            if n.tag in BLOCKS:
                close()
        elif n.tag == "br":
            run.append("\n")
        else:
            if n.tag in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(n.children))
    close()
    return out


def extract(page: str | None) -> str:
    """The main text of one page, empty if it has none."""
    if not page:
        return ""
    kept = score(parse(page))
    net = lambda n: n.points * (1 - n.linked / n.size) if n.size else 0.0
    best = max((n for n in kept if n.points > 0 and n.tag not in ("#root", "html", "p")), key=net, default=None)
    if best is None:
        holder = next((n for n in kept if n.tag in ("article", "main")), None)
        return "\n\n".join(blocks(holder)) if holder else ""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is None:
        nested = [n for n in kept if n.tag == "article"] or [n for n in kept if n.tag == "main"]
        up = max(nested, key=net) if nested and best.holds else None
    if up is not None:
        best = up
    keep = [best]
    if best.parent is not None and up is None:
        least = max(10, 0.2 * net(best))
        at = next(i for i, c in enumerate(best.parent.children) if c is best)
        for i, c in enumerate(best.parent.children):
            if c is best or type(c) is str or c.drop:
                continue
            dense = c.linked / c.size if c.size else 1
            heading = c.tag in HEADINGS and i < at
            if heading and dense < 0.5 or net(c) >= least or c.tag in ("p", "pre", "blockquote", "figure", "ul", "ol") and dense < 0.25 and c.size > 25:
                keep.append(c)
        order = {id(c): i for i, c in enumerate(best.parent.children)}
        keep.sort(key=lambda c: order[id(c)])
    return "\n\n".join(x for n in keep for x in blocks(n))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.read(spark, sf_dir, "pages"))
