"""Operator 9: main text of web pages by tree scoring.

A page is read into a tree whose leaves are blocks: runs of inline text between
block-level tags. Each block passes points for its length and its commas to its
container, by half to the container above, and by a quarter to the next; tags
and names that tell of articles add points. A container's points are discounted
by its link density, and the best container wins. Where it is only a part (the
container around it is an article or main, or holds half as many points again,
in text that is not mostly links) the one around it takes its place. Siblings
with a fifth of its points, and long plain blocks and headings beside it, are
kept with it; within it, parts that are mostly links go. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are known
by tag, role, or words of class and id, and neither score nor appear.

Time grows with the length of the page alone: each character is read once, and
sums go from children to parents once.

Defined results: null or empty html gives an empty text; html without tags is one
block; text of pages without any container that scores is all that is not menu
or markup; each row is read for itself; other columns are not looked at; an
empty table gives an empty result. Unclosed and stray tags are tolerated; a tag
that never ends takes the rest of the page with it; there is no bound on length
or depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAME = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)\s*(=?)\s*")
BARE = re.compile(r"[^\s>]*")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCKS = set("html body div article section main aside nav header footer p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption form fieldset address details summary dialog center hgroup head menu".split())
INLINE_UNWANTED = {"button", "label", "canvas", "audio", "video"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A tag that opens closes these, if one of them is the innermost, in turn.
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["td", "th", "tr"], "td": ["td", "th"], "th": ["td", "th"]}
UNWANTED = {"nav", "footer", "aside", "form", "head", "dialog", "menu"} | INLINE_UNWANTED
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|replies|disqus|cookies?|consent|gdpr|notice|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|popup|modal|widget|toolbar|pagination|pager|skip|copyright|legal)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}


LEAVES = {"p", "li", "td", "th", "pre", "dt", "dd", "blockquote", "figcaption", "caption", "summary", "tr", "ul", "ol", "table", "tbody", "thead", "dl", "figure", "address"} | HEADINGS
TOPS = {"#", "html", "body"}


class Node:
    """``container``: the node itself, or the nearest above that is no leaf tag;
    ``whole``, ``chars``, ``linked``, ``links``: points, characters, characters
    in links and links of all blocks below, the node's own included."""

    __slots__ = ("tag", "up", "bad", "within", "good", "container", "points", "scored", "whole", "chars", "linked", "links", "keep")

    def __init__(self, tag: str, up: "Node | None", bad: bool = False, good: float = 0.0):
        self.tag, self.up, self.bad, self.good = tag, up, bad, good
        self.within = tag in ("article", "main") or up is not None and up.within
        self.container = self if tag not in LEAVES or up is None else up.container
        self.points, self.scored, self.whole = 0.0, False, 0.0
        self.chars = self.linked = self.links = 0
        self.keep: bool | None = None

    def value(self) -> float:
        return self.points * (1 - density(self))


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def unwanted(tag: str, attrs: list[tuple[str, str]], up: Node) -> tuple[bool, float]:
    """Whether a subtree is no main text, and what its names add to its points."""
    bad = tag in UNWANTED or (tag == "header" and not up.within)
    good = 25.0 if tag in ("article", "main") else 0.0
    for name, value in attrs:
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            bad |= bool(NOISE.search(value)) and not GOOD.search(value)
            good += 15.0 * bool(GOOD.search(value))
        elif name == "role":
            bad |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            bad = True
    return bad, good


class Reader:
    """Reads a page into ``nodes`` (parents before children) and ``blocks``."""

    def __init__(self, page: str):
        self.page = page
        root = Node("#", None)
        self.stack, self.nodes, self.blocks = [root], [root], []
        self.open: Counter[str] = Counter()
        #: Unwanted inline elements: node, how many of its tag are open in it, and the text before it in its block.
        self.inside: dict[str, list[list]] = {}
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.anchor = False
        self.ended: set[str] = set()  # quotes that the rest of the page lacks

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                node = self.stack[-1]
                self.blocks.append((node, text))
                node.chars += len(text)
                node.linked += min(self.linked, len(text))
                node.links += self.links
        self.parts, self.linked, self.links = [], 0, 0

    def push(self, node: Node) -> None:
        self.flush()
        self.stack.append(node)
        self.nodes.append(node)
        self.open[node.tag] += 1

    def pop_to(self, tag: str) -> None:
        """Close up to the innermost ``tag``, if one is open."""
        while self.open[tag]:
            self.flush()
            node = self.stack.pop()
            self.open[node.tag] -= 1
            held = self.inside.get(node.tag)
            if held and held[-1][0] is node:
                self.parts, self.linked, self.links = held.pop()[2]
            if node.tag == tag:
                return

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """Attributes from ``at``, whether the tag closes itself, and where the
        tag ends (-1: never)."""
        page, found, n = self.page, [], len(self.page)
        while True:
            m = NAME.match(page, at)
            at = m.end()
            if not m[1] and not m[2]:
                if at >= n:
                    return found, False, -1
                return found, page[at - 1] == "/", at + 1  # at ">"
            value, quote = "", page[at : at + 1]
            if m[2]:
                end = page.find(quote, at + 1) if quote in ("'", '"') and quote and quote not in self.ended else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    self.ended |= {quote} & {"'", '"'}
                    v = BARE.match(page, at)
                    value, at = v[0], v.end()
            if len(found) < 1000:
                found.append((m[1].lower(), value))

    def read(self) -> "Reader":
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt != at:
                lt = n if lt < 0 else lt
                self.text(page[at:lt])
                at = lt
                continue
            m = TAG.match(page, at)
            if m is None:
                if page.startswith("<!--", at):
                    end = page.find("-->", at + 4)
                    at = n if end < 0 else end + 3
                elif page[at + 1 : at + 2] in ("!", "?", "/"):
                    end = page.find(">", at)
                    at = n if end < 0 else end + 1
                else:
                    self.text("<")
                    at += 1
                continue
            tag, closing = m[1].lower(), page[at + 1] == "/"
            attrs, empty, at = self.attributes(m.end())
            if at < 0:
                break
            if closing:
                self.end(tag)
            elif tag in RAW:
                if not empty:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    at = n if end is None else page.find(">", end.end()) + 1 or n
            else:
                self.start(tag, attrs, empty)
        while len(self.stack) > 1:
            self.pop_to(self.stack[-1].tag)
        self.flush()
        return self

    def text(self, text: str) -> None:
        self.parts.append(text)
        if self.anchor:
            self.linked += len(text.strip())

    def start(self, tag: str, attrs: list[tuple[str, str]], empty: bool) -> None:
        top = self.stack[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
        elif tag in BLOCKS or tag in UNWANTED and tag not in INLINE_UNWANTED:
            self.flush()
            for closed in (["p"] if tag in BLOCKS else []) + CLOSES.get(tag, []):
                if self.stack[-1].tag == closed:
                    self.pop_to(closed)
            top = self.stack[-1]
            bad, good = unwanted(tag, attrs, top)
            if not empty:
                self.push(Node(tag, top, top.bad or bad, good))
                self.anchor = False
        else:
            if tag == "a":
                self.anchor = True
                self.links += 1
            if self.inside.get(tag):
                self.inside[tag][-1][1] += 1
            elif (attrs or tag in UNWANTED) and not empty and unwanted(tag, attrs, top)[0]:
                before = self.parts, self.linked, self.links
                self.parts, self.linked, self.links = [], 0, 0
                self.push(Node(tag, top, True))
                self.inside.setdefault(tag, []).append([self.stack[-1], 1, before])

    def end(self, tag: str) -> None:
        if tag == "a":
            self.anchor = False
        held = self.inside.get(tag)
        if held:
            held[-1][1] -= 1
            if not held[-1][1]:
                self.pop_to(tag)
        elif tag in ("br", "p") and not self.open[tag]:
            self.flush() if tag == "p" else self.parts.append(" ")
        elif tag in BLOCKS or tag in UNWANTED:
            self.pop_to(tag)


def extract(page: str) -> str:
    """The main text of a page."""
    read = Reader(page).read()
    found = [(node, text) for node, text in read.blocks if not node.bad]
    if not found:
        return ""
    for node, text in found:
        if node.tag in HEADINGS:
            continue
        points = 1 + text.count(",") + text.count("\uff0c") + min(len(text) / 100, 3)
        node.whole += points
        top, share = node.container, 1.0
        while top.up and share > 0.2:
            top.points += points * share
            top.scored = True
            top, share = top.up.container, share / 2
    scored = [x for x in read.nodes if x.scored]
    if not scored:
        return "\n\n".join(text for _, text in found)
    for x in reversed(read.nodes):  # children before parents
        if x.scored:
            x.points += x.good
        if x.up and not x.bad:
            x.up.whole += x.whole
            x.up.chars += x.chars
            x.up.linked += x.linked
            x.up.links += x.links
    best = max(scored, key=Node.value)
    while best.up.container.tag not in TOPS:
        up = best.up.container
        chars, linked = up.chars - best.chars, up.linked - best.linked
        part = up.tag in ("article", "main") or up.whole >= 1.5 * best.whole
        if not part or chars and linked > 0.5 * chars:
            break
        best = up
    least = 0.2 * best.value()
    for x in read.nodes:  # parents before children
        if x is best:
            x.keep = True
        elif x.up is not None and x.up.keep is not None:
            x.keep = x.up.keep and not (x.links > 2 and density(x) > 0.5)
        elif x.up is best.up and x.tag not in TOPS and x.tag not in LEAVES and not x.bad:
            x.keep = x.scored and x.value() >= least
    beside = best.up

    def kept(node: Node, text: str) -> bool:
        if node.keep is not None:
            return node.keep
        near = node is beside or node.up is beside or node.container is beside
        return near and (len(text) > 80 and density(node) < 0.25 or node.tag in ("h1", "h2"))

    return "\n\n".join(text for node, text in found if kept(node, text))


def extract_all(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and ``text``."""
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(work, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_all(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
