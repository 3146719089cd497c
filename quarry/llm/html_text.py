"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import frugal, table

#: A comment, a declaration, or a tag whose quoted values may hold '>'; if a quote doesn't end, the tag ends at its first '>'.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(?:((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)|([^>]*))>", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*+(?:=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
# HTML element names by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = {"p", "div", "article", "section", "main", "body", "html", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "hr", "address", "details", "summary"}
CLOSES_P = BLOCK | {"nav", "header", "footer", "aside", "form", "fieldset"}
BOILER = {"head", "nav", "header", "footer", "aside", "button", "select", "option", "dialog", "menu"}
MARKS = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "banner", "cookie", "cookies", "consent", "notice", "notices", "notification", "alert", "promo", "sponsor", "sponsored", "comment", "comments", "disqus", "replies", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related", "newsletter", "subscribe", "popup", "modal", "search", "login", "contentinfo", "complementary", "masthead", "widget"}
#: Words that may stand beside one of MARKS in a name, as in "comment-list".
BESIDE = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "form", "group", "home", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "mobile", "outer", "overlay", "page", "panel", "popup", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "stories", "text", "top", "unit", "widget", "wrap", "wrapper"}
HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
#: Tags that end an open element of the first set, unless one of the second is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}


class Node:
    __slots__ = ("chars", "kids", "links", "mark", "score", "tag", "up")

    def __init__(self, tag: str, up: Node | None) -> None:
        self.tag, self.up, self.kids, self.score, self.chars, self.links, self.mark = tag, up, [], 0.0, 0, 0, False


def marked(attributes: str) -> bool:
    """Whether class, id or role names a part that is no main text: a name that is one of MARKS, or of such words and BESIDE alone."""
    for name, value in ATTR.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for each in value.strip("\"'").lower().split():
                words = [w for w in re.split(r"[^a-z]+", each) if w]
                if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
                    return True
    return False


def parse(html: str) -> Node:
    """A tree without the parts that never hold main text. Text is kept raw, as strings among kids.

    Dropped elements are read like others, so each ends where HTML ends it, with or without an end tag."""
    root = here = Node("html", None)
    at, found, last = 0, False, html.rfind(">")
    live = Counter()  # open elements by tag, so that no search for one that isn't open is made

    def leave(to: Node) -> Node:
        node = here
        while node is not to:
            live[node.tag] -= 1
            node = node.up
        return to

    while (m := TOKEN.search(html, at) if at <= last or html.find("<!", at) >= 0 else None) is not None:
        text, at = html[at : m.start()], m.end()
        tag, closing, rest = (m[2] or "").lower(), bool(m[1]), m[3] if m[3] is not None else m[4] or ""
        if here.tag == "head" and (text and not text.isspace() or tag and not closing and tag not in HEAD):
            here = leave(here.up)
        if text:
            here.kids.append(text)
        if not tag:
            continue
        if not closing and tag in RAW:
            end = _raw_end(tag).search(html, at)
            at = len(html) if end is None else end.start()
            continue
        if closing:
            if live[tag]:
                node = here
                while node.tag != tag:
                    node = node.up
                if node.up is not None:
                    here = leave(node.up)
            continue
        if tag in VOID:
            here.kids.append(Node(tag, here)) if tag == "hr" else here.kids.append(" ") if tag == "br" else None
            continue
        if tag in CLOSES_P and live["p"]:
            node = here
            while node is not None and node.tag != "p" and node.tag not in BLOCK and node.tag not in BOILER:
                node = node.up
            if node is not None and node.tag == "p":
                here = leave(node.up)
        if tag in ENDS and any(live[x] for x in ENDS[tag][0]):
            (ended, bounds), node = ENDS[tag], here
            while node is not None and node.tag not in ended and node.tag not in bounds and node.tag not in ("article", "main", "body"):
                node = node.up
            if node is not None and node.tag in ended and node.up is not None:
                here = leave(node.up)
        mark = tag == "form" or tag not in ("html", "body", "article", "main") and bool(rest) and marked(rest)
        if (tag in BOILER or mark) and rest.rstrip().endswith("/"):
            continue
        node = Node(tag, here)
        if tag in BOILER:
            here.kids.append(Node("hr", here))
        else:
            here.kids.append(node)
            node.mark = mark
            found |= mark
        here = node
        live[tag] += 1
    if at < len(html):
        tail = html[at:]
        here.kids.append(tail if not re.match(r"<[a-zA-Z/!]", tail) else "")
    if found:
        _prune(root)
    return root


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


def _prune(root: Node) -> None:
    """Drop forms and elements whose names say they are no main text, but not those around the article.

    Kept is one that holds an article or main, where none stands outside of such elements; one with more than half of the
    page's paragraphs and their text, within an article or main or where none stands beside it. Those within a kept one are
    judged anew."""
    found: dict[int, tuple[int, int, bool]] = {}  # paragraphs, their characters, whether there is an article or main
    for node in reversed(_walk(root)):
        n, chars, holds, plain = 0, 0, node.tag in ("article", "main"), 0
        for k in node.kids:
            if isinstance(k, str):
                plain += 0 if k.isspace() else len(k)
            else:
                a, b, c = found[id(k)]
                n, chars, holds = n + a, chars + b, holds or c
                node.chars += 0 if k.tag == "a" else k.chars
        node.chars += plain  # here without links
        if node.tag in PARAGRAPH and node.chars:
            n, chars = max(n, 1), node.chars
        found[id(node)] = n, chars, holds
    every, whole = _walk(root), found[id(root)]
    for node in every:
        node.chars = 0
    within: set[int] = set()  # nodes in an article or main
    for node in every:
        if node.tag in ("article", "main") or node.up is not None and id(node.up) in within:
            within.add(id(node))
    scopes = [root]
    while scopes:
        free, inner, stack = False, [], [scopes.pop()]
        while stack:
            node = stack.pop()
            free = free or node.tag in ("article", "main")
            for k in node.kids:
                if isinstance(k, Node):
                    (inner if k.mark else stack).append(k)
        holding = [k for k in inner if found[id(k)][2]]
        for k in inner:
            n, chars, holds = found[id(k)]
            most = 2 * n > whole[0] and 2 * chars > whole[1]
            if most and (holds or id(k) in within) if free else holds if holding else most:
                k.mark = False
                scopes.append(k)
            else:
                k.tag, k.kids = "hr", []


def _walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        out.append(node := stack.pop())
        stack += [k for k in node.kids if isinstance(k, Node)]
    return out


def blocks(nodes: list[Node]) -> str:
    """The text of the nodes, a line for each block that has any."""
    lines, run = [], []

    def flush() -> None:
        if run:
            line = " ".join(unescape("".join(run)).split())
            run.clear()
            if line:
                lines.append(line)

    stack: list = [*reversed(nodes)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(x.kids)
        else:
            stack += reversed(x.kids)
    flush()
    return "\n".join(lines)


def main_text(html: str) -> str:
    """Paragraphs pass points for length and commas to their ancestors, less for each level; links discount a container.

    The best container shows where the text is, its points drop nothing: inside an article or main all outermost ones are
    taken whole, but for others that are mostly links; elsewhere all that is not mostly links."""
    nodes = _walk(parse(html))
    for node in reversed(nodes):
        for k in node.kids:
            node.chars += (0 if k.isspace() else len(k)) if isinstance(k, str) else k.chars
            node.links += 0 if isinstance(k, str) else k.chars if k.tag == "a" else k.links
    touched = []
    for node in nodes:
        if node.tag in PARAGRAPH or (node.tag in ("div", "article", "section", "main", "body") and any(isinstance(k, str) and k.strip() for k in node.kids)):
            own = sum(len(k) for k in node.kids if isinstance(k, str)) if node.tag not in PARAGRAPH else node.chars
            commas = sum(k.count(",") for k in node.kids if isinstance(k, str))
            points = (1 + commas + min(own // 100, 3)) if own - (node.links if node.tag in PARAGRAPH else 0) > 0 else 0
            up, share = (node.up if node.tag in PARAGRAPH else node), 1.0
            while up is not None and share > 0.1 and points:
                touched.append(up)
                up.score += points * share
                up, share = up.up, share / 2 if share == 1 else share / 3
    for node in {id(n): n for n in touched}.values():
        node.score = (node.score + 25 * (node.tag in ("article", "main"))) * (1 - node.links / max(1, node.chars))
    best = max(touched, key=lambda n: n.score, default=None)
    if best is None:
        best = next((n for n in nodes if n.tag in ("article", "main") and n.chars), None)
        return "" if best is None else blocks([best])
    outer, up = None, best
    while up is not None:
        outer, up = up if up.tag in ("article", "main") else outer, up.up
    if outer is None:
        return blocks(_around(best))
    near, stack = [], [nodes[0]]
    while stack:
        node = stack.pop()
        if node.tag not in ("article", "main"):
            stack += reversed([k for k in node.kids if isinstance(k, Node)])
        elif node is outer or 2 * node.links < node.chars:
            near.append(node)
    return blocks(near)


def _around(best: Node) -> list:
    """best and, on each level above it, blocks and runs of inline parts of which less than half is links."""
    left, right, node = [], [], best
    while node.up is not None:
        sides, run, chars, links = ([], []), [], 0, 0
        side = sides[0]
        for k in [*node.up.kids, None]:
            inline = isinstance(k, str) or k is not None and k is not node and k.tag not in BLOCK
            if inline:
                run.append(k)
                chars += (0 if k.isspace() else len(k)) if isinstance(k, str) else k.chars
                links += 0 if isinstance(k, str) else k.chars if k.tag == "a" else k.links
                continue
            if chars > 2 * links:
                side += run
            run, chars, links = [], 0, 0
            if k is node:
                side = sides[1]
            elif k is not None and k.chars > 2 * k.links:
                side.append(k)
        left.append([*sides[0], Node("hr", None)])
        right += [Node("hr", None), *sides[1]]
        node = node.up
    return [*(x for level in reversed(left) for x in level), best, *right]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row. Null and empty html, and pages without main text, give an empty text."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [main_text(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": got, "n_chars": [*map(len, got)]})

    whole = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return whole.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
