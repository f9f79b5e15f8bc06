"""Main text of web pages, with site templates removed.

Each page is parsed into a tree (unclosed and misnested tags as browsers close them; a tag or quote that never
ends takes the rest of the page).  Its main part is its articles, else its main element, else its body.  Element
subtrees of the main part that can be furniture are hashed (tag, text, children) and counted per host in
Spark; a subtree found on at least ``MIN_PAGES`` distinct pages of its host is a template and is deleted,
however large the host.  Pages are distinct if their trees are, so copies of a page count once and keep
their text.  Prose blocks (paragraphs, headings, quotes) inside an article are never templates, nor is what
holds an article: articles that share a passage keep it.

Recurrence needs no hint in the markup.  What is furniture on a single page already goes by its element (menus,
forms, sidebars, page headers and footers, scripts, styles), its role, or a class or id that names nothing but
furniture (``cookie-notice``, ``comment-list``; not ``notice-period``).

Templates stay (host, digest) rows and are joined to the subtrees of the pages, so no host has a list and no list
is longer than a page.  Pages with a template are found by a bitmap of fixed size; only their blocks, with the
spans of the subtrees around them, are shuffled.  Parsing takes time in proportion to the page.

Text: character references decoded, white space inside a block is one space, blocks trimmed and joined by
one \\n in page order, empty blocks left out.

Defined results: null or empty html gives the empty text; a null url is the host ''; repeated rows are one page
in the counts, and each has its text; pages of any length are read whole; an empty table gives an empty result; extra columns
are passed through (``text`` replaces a same-named input column)."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import may_hold, small, stored, widened

MIN_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th "
                  "thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead figcaption summary".split())
FURNITURE = frozenset("head nav footer aside form script style title textarea noscript iframe template svg math button select "
                      "option dialog menu object canvas audio video xmp noembed noframes label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that name furniture, and parts that say nothing beside them.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie "
                  "cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login menu "
                  "nav navbar navigation breadcrumb breadcrumbs footer masthead sidebar sidenav related recommended share "
                  "sharing social comment comments reply replies respond disqus pagination pager widget toolbar skip".split())
PLAIN = frozenset("a and area bar block bottom box buttons container content footer for form foot global group header head holder icons inner "
                  "item items left link links list main mobile module outer page panel post posts right row rows section site "
                  "slot space text thread title to top unit user wrap wrapper".split())
_REGIONS = frozenset(("article", "main"))
#: Open elements that a start tag closes, unless one that stops the search was opened later.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",))}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(\"|'|[^\s>\"'][^\s>]*)?)?")
_GAP = re.compile(r"[\s/]*")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "drop", "children", "digest", "holds")

    def __init__(self, tag: str, drop: bool) -> None:
        self.tag, self.drop, self.children = tag, drop, []
        self.digest, self.holds = 0, False  # hash of the subtree; whether it holds an article or main element


def _names_furniture(value: str) -> bool:
    for name in value.lower().split():
        parts = [p for p in _SPLIT.split(name) if p and not p.isdigit()]
        if not WORDS.isdisjoint(parts) and all(p in WORDS or p in PLAIN for p in parts):
            return True
    return False


def _drops(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element is furniture by its tag or attributes."""
    if tag in FURNITURE:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    named = _names_furniture(attributes.get("class", "") + " " + attributes.get("id", ""))
    if tag == "article":
        return named and "comment" in (attributes.get("class", "") + attributes.get("id", "")).lower()
    return (named or attributes.get("role", "").strip().lower() in ROLES or "hidden" in attributes
            or attributes.get("aria-hidden", "").strip().lower() == "true"
            or "display:none" in "".join(attributes.get("style", "").lower().split()))


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of the tag whose name ends at ``at``, the place behind its ``>`` (-1 if it has none), and
    whether it ends in ``/``."""
    out: dict[str, str] = {}
    n = len(page)
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= n:
            return out, -1, False
        if page[at] == ">":
            return out, at + 1, "/" in gap[0]
        m = _ATTRIBUTE.match(page, at)
        name, value = m[1].lower(), m[2]
        at = m.end()
        if value in ("\"", "'"):
            end = page.find(value, at)
            if end < 0:
                return out, -1, False
            value, at = page[at:end], end + 1
        out.setdefault(name, entities.unescape(value) if value else "")


class _Tree:
    """Open elements, with their places by tag, so that no search walks down the stack."""

    def __init__(self) -> None:
        self.root = Node("#page", False)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def shut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.open) > place:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def start(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)


def parse(page: str) -> Node:
    tree, at, n = _Tree(), 0, len(page)
    while at < n:
        tag_at = page.find("<", at)
        if tag_at < 0:
            tag_at = n
        if tag_at > at:
            tree.open[-1].children.append(page[at:tag_at])
        if tag_at >= n:
            break
        at = tag_at + 1
        mark = page[at: at + 1]
        if mark in ("!", "?"):
            comment = page.startswith("!--", at)
            end = page.find("-->" if comment else ">", at)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = mark == "/"
        name = _NAME.match(page, at + closing)
        if not name:
            if closing:  # no tag: browsers skip it like a comment
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                tree.open[-1].children.append("<")
            continue
        tag = name[0].lower()
        attributes, at, empty = _attributes(page, name.end())
        if at < 0:
            break
        if closing:
            place = tree.last(tag)
            # an inline end tag closes nothing outside its block
            if place and (tag in BLOCK or not tree.blocks or tree.blocks[-1] < place):
                tree.shut(place)
            continue
        if tag in BLOCK and tree.blocks and tree.open[tree.blocks[-1]].tag == "p":
            tree.shut(tree.blocks[-1])
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            stopped = max(map(tree.last, stop))
            inside = [p for t in shut for p in (tree.last(t),) if p > stopped]
            if inside:
                tree.shut(min(inside))
        node = Node(tag, _drops(tag, attributes))
        tree.open[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            at = _raw_end(page, at, tag)
            continue
        if not empty or tag in BLOCK:
            tree.start(node)
    return tree.root


def _raw_end(page: str, at: int, tag: str) -> int:
    """The place behind the end tag of an element that holds no markup."""
    for m in re.compile(f"</{tag}(?=[\\s/>])", re.I).finditer(page, at):
        end = page.find(">", m.end())
        return len(page) if end < 0 else end + 1
    return len(page)


def measure(node: Node) -> None:
    """Digest of every subtree, and whether it holds an article, without recursion."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if not isinstance(c, str)]
    for x in reversed(order):
        h = xxhash.xxh64(x.tag)
        x.holds = x.tag in _REGIONS
        for c in x.children:
            if isinstance(c, str):
                if s := " ".join(c.split()):
                    h.update(s)
            else:
                h.update(c.digest.to_bytes(8, "little"))
                x.holds = x.holds or c.holds
        x.digest = h.intdigest()


def _tops(root: Node) -> list[Node]:
    """The outermost articles that are no furniture; without any, the first main element; else the body."""
    found: dict[str, list[Node]] = {}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.drop:
            continue
        if x.tag in ("article", "main", "body"):
            found.setdefault(x.tag, []).append(x)
            if x.tag == "article":
                continue
        todo += [c for c in reversed(x.children) if not isinstance(c, str)]
    return found.get("article") or found.get("main", found.get("body", [root]))[:1]


def blocks(page: str) -> tuple[int, list[str], list[tuple[int, int, int]]]:
    """The digest of a page's tree, the texts of its main blocks in order, and the subtrees that may be templates:
    digest (signed long), first block, and the one past the last."""
    root = parse(page)
    measure(root)
    signed = lambda d: d - (d >> 63 << 64)
    out: list[str] = []
    spans: list[tuple[int, int, int]] = []
    line: list[str] = []

    def flush() -> None:
        if s := " ".join(entities.unescape("".join(line)).split()):
            out.append(s)
        line.clear()

    for top in _tops(root):
        prose = top.tag in _REGIONS
        work: list = [*reversed(top.children)]
        while work:
            x = work.pop()
            if x is None:  # the end of a block
                flush()
            elif isinstance(x, tuple):  # the end of one that may be a template
                flush()
                if len(out) > x[1]:
                    spans.append((*x, len(out)))
            elif isinstance(x, str):
                line.append(x)
            elif x.drop or x.tag == "header" and not prose:
                if x.tag in BLOCK:
                    flush()
            elif x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                flush()
                work.append(None if x.holds or prose and x.tag in PROSE else (signed(x.digest), len(out)))
                work += reversed(x.children)
            else:
                work += reversed(x.children)
        flush()
    return signed(root.digest), out, spans


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def _pages(pages: DataFrame, *more) -> DataFrame:
    """host, page (hash of the html), html and more."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(*more, _host().alias("host"), F.xxhash64(body).alias("page"), body.alias("html"))


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        trees, hashes = [], []
        for page in b.column("html").to_pylist():
            tree, _, spans = blocks(page)
            trees.append(tree)
            hashes.append(sorted({h for h, _, _ in spans}))
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(trees, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                                         names=["host", "page", "tree", "hashes"])


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, tree, h): the subtrees that may be templates, once for each host and html."""
    trees = _pages(pages).mapInArrow(_hash_pages, "host string, page long, tree long, hashes array<long>")
    return stored(trees.select("host", "page", "tree", F.explode("hashes").alias("h")).distinct(), "page-subtrees")


def site_templates(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h): the subtrees that recur over a host's distinct pages."""
    counts = subtrees.select("host", "tree", "h").distinct().groupBy("host", "h").count()
    return stored(counts.where(F.col("count") >= min_pages).select("host", "h"), "templates")


def page_templates(subtrees: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, page, templates): the templates on each page that has any."""
    rows = subtrees.select("host", "page", "h").distinct().join(templates, ["host", "h"])
    return stored(rows.groupBy("host", "page").agg(F.collect_set("h").alias("templates")), "page-templates")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of pages without templates."""
    for b in small(batches):
        texts = ["\n".join(blocks(page)[1]) for page in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])


_SPANS = pa.list_(pa.struct([("h", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        parts = [blocks(page) for page in b.column("html").to_pylist()]
        spans = [[{"h": h, "low": low, "high": high} for h, low, high in p[2]] for p in parts]
        yield pa.RecordBatch.from_arrays([b.column("rest"), b.column("host"), b.column("page"), pa.array([p[1] for p in parts], pa.list_(pa.string())), pa.array(spans, _SPANS)],
                                         names=["rest", "host", "page", "texts", "spans"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Input columns but html, then text."""
    rest = [c for c in pages.columns if c not in ("html", "text")]
    rows = _pages(pages, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))  # a struct, so that no name clashes
    subtrees = page_subtrees(pages)
    lists = page_templates(subtrees, site_templates(subtrees, min_pages))
    marked = may_hold(rows, lists, "host", "page")
    clear = marked.where("not _may").select("rest", "html").mapInArrow(_whole, widened(rows.select("rest"), text="string"))
    parted = marked.where("_may").select("rest", "host", "page", "html").mapInArrow(
        _parted, widened(rows.select("rest", "host", "page"), texts="array<string>", spans="array<struct<h: bigint, low: int, high: int>>"))
    parted = parted.join(lists, ["host", "page"], "left").withColumn("templates", F.coalesce("templates", F.array().cast("array<bigint>")))
    parted = parted.withColumn("gone", F.expr("filter(spans, s -> array_contains(templates, s.h))"))
    kept = F.expr("filter(texts, (t, i) -> not exists(gone, s -> s.low <= i and i < s.high))")
    return clear.unionByName(parted.select("rest", F.array_join(kept, "\n").alias("text"))).select("rest.*", "text")
