"""Cleaning a page's tree and finding the node with its main content."""

from __future__ import annotations

import math
import re

from quire.html.dom import Node

# Elements that never hold content, names of boilerplate and of content.
DROP_TAGS = {
    "script", "style", "noscript", "iframe", "svg", "canvas", "form", "input", "button", "select", "textarea", "nav", "aside", "footer",
    "header", "menu", "template", "link", "meta", "object", "embed",
}
NOISE_WORDS = [
    "nav", "navbar", "navigation", "menu", "sidebar", "side-bar", "footer", "header", "masthead", "comment", "comments", "disqus", "share", "sharing", "social", "related",
    "recommend", "subscribe", "newsletter", "signup", "promo", "advert", "ads?", "sponsor", "banner", "cookie", "gdpr", "breadcrumb", "pagination", "pager", "tags?-list",
    "widget", "skip-link", "screen-reader", "sr-only", "visually-hidden",
]
CONTENT_WORDS = ["article", "post", "content", "entry", "main", "body", "essay", "text", "markdown", "story"]
BAD_CLASS = re.compile(r"comment|sidebar|footer|nav|meta|share", re.I)
# Semantic candidates as (strategy, bonus), and confidence by strategy.
SEMANTIC = {
    "article-tag": 220, "main-tag": 160, "role-main": 160, "class:post-content": 200, "class:entry-content": 200, "class:article-content": 200, "class:markdown-body": 200,
}
BASE_CONFIDENCE = {
    "article-tag": 0.92, "main-tag": 0.85, "role-main": 0.85, "class:post-content": 0.9, "class:entry-content": 0.9, "class:article-content": 0.9, "class:markdown-body": 0.9,
    "heuristic": 0.62, "body-fallback": 0.28,
}
CANDIDATE_TAGS = ("div", "section", "article", "main", "td", "body")
CONTAINERS = ("div", "section", "ul")


def _any_word(ws: list[str]) -> re.Pattern:
    return re.compile(r"(?:^|[-_ ])(?:" + "|".join(ws) + r")(?:$|[-_ ])", re.I)


NOISE, CONTENT = _any_word(NOISE_WORDS), _any_word(CONTENT_WORDS)
_TAG = re.compile(r"<[^>]+>")
_BLANKS = re.compile("[ \t ]+")
_LINES = re.compile(r"\n{3,}")
_PUNCT = re.compile(r"[,，。.！!？?；;：:]")


def tidy(s: str | None) -> str:
    """White space as in `clean_text`."""
    s = (s or "").replace("​", "").replace("﻿", "")
    return _LINES.sub("\n\n", _BLANKS.sub(" ", s)).strip()


def names(n: Node) -> str:
    return " ".join(x for x in (n.get("class"), n.get("id"), n.get("role")) if x)


def text_of(n: Node) -> str:
    return tidy(_TAG.sub("", n.text()))


class Texts(dict):
    """Nodes to their texts, each made once."""

    def __missing__(self, n: Node) -> str:
        t = self[n] = text_of(n)
        return t


def link_density(n: Node, texts: Texts | None = None) -> float:
    """Share of the text inside links; 0 for very short texts."""
    texts = Texts() if texts is None else texts
    size = len(texts[n])
    return sum(len(texts[a]) for a in n.find("a")) / size if size >= 40 else 0.0


def prune(root: Node) -> None:
    """Take out elements without content, named boilerplate, and short lists of links. Text behind a removed element stays."""
    stack = [root]
    while stack:
        n = stack.pop()
        for c in n.elements():
            if c.tag in DROP_TAGS or c.tag in CONTAINERS and (NOISE.search(names(c)) or _is_link_list(c)):
                c.remove()
            else:
                stack.append(c)


def _is_link_list(n: Node) -> bool:
    texts = Texts()
    return len(texts[n]) < 800 and link_density(n, texts) > 0.7


# What a property of a node is worth, up to a bound on the property; then what its names are worth.
WORTH = {"text": (1 / 12, 24000), "in paragraphs": (1 / 20, 24000), "paragraphs": (2.0, 60), "marks": (0.5, 600), "link share": (-200.0, math.inf), "links over 30": (-3.0, math.inf), "without marks": (-90.0, 1), "named content": (70.0, 1), "named otherwise": (-120.0, 1), "body": (-45.0, 1)}
SHORT = 120


def score(n: Node, texts: Texts | None = None) -> float:
    """How much a node looks like main content: length, paragraphs, punctuation, less links; negative for short ones."""
    texts = Texts() if texts is None else texts
    size = len(texts[n])
    if size < SHORT:
        return -1.0
    paragraphs, links, marks, called = list(n.find("p")), sum(1 for _ in n.find("a")), len(_PUNCT.findall(texts[n])), names(n)
    has = {
        "text": size, "in paragraphs": sum(len(texts[p]) for p in paragraphs), "paragraphs": len(paragraphs), "marks": marks, "link share": link_density(n, texts), "links over 30": max(0, links - 30),
        "without marks": size > 400 and marks < 0.005 * size, "named content": bool(CONTENT.search(called)), "named otherwise": bool(BAD_CLASS.search(called)), "body": n.tag == "body",
    }
    return sum(worth * min(has[k], most) for k, (worth, most) in WORTH.items())


def strategies_of(n: Node) -> list[str]:
    """The semantic strategies under which a node is a candidate."""
    out = []
    if n.tag in ("article", "main"):
        out.append(f"{n.tag}-tag")
    if n.get("role") == "main":
        out.append("role-main")
    return out + [s for s in SEMANTIC if s.startswith("class:") and s[6:] in n.get("class")]


def find_content(root: Node, adapter=None) -> tuple[Node, float, str]:
    """(node, confidence, strategy) of the main content. An adapter's own selectors come before everything."""
    if adapter is not None:
        got = _by_adapter(root, adapter)
        if got:
            return got
    # among equals an earlier strategy wins, and in it the earlier node
    best: tuple | None = None
    order, texts = list(SEMANTIC), Texts()
    for at, n in enumerate(root.walk()):
        semantic = strategies_of(n)
        plain = n.tag in CANDIDATE_TAGS
        if not semantic and not plain:
            continue
        s = score(n, texts)
        long = len(texts[n]) >= 200
        tries = [(s + SEMANTIC[k], -order.index(k), -at, k) for k in semantic if long] + ([(s, -len(order), -at, "heuristic")] if plain else [])
        for t in tries:
            if t[0] > -1.0 and (best is None or t[:3] > best[0][:3]):
                best = (t, n)
    if best is None:
        body = next(root.find("body"), root)
        return body, confidence(body, "body-fallback"), "body-fallback"
    return best[1], confidence(best[1], best[0][3]), best[0][3]


def _by_adapter(root: Node, adapter) -> tuple[Node, float, str] | None:
    from quire.html.xpath import select

    name = f"adapter:{adapter.name}"
    for path in adapter.content_xpath or []:
        found = select(root, path)
        for n in found:
            if len(text_of(n)) >= 150:
                return n, 0.95, name
        for n in found:
            if text_of(n) or next(n.find("img"), None):
                return n, 0.55, f"{name}:short"
        if found:
            return found[0], 0.4, f"{name}:empty"
    for n in root.find("td"):
        if len(text_of(n)) > 800 and sum(1 for _ in n.find("br")) > 5 and score(n) > 0:
            return n, 0.8, f"{name}:td-fallback"
    return None


def confidence(n: Node, strategy: str) -> float:
    """The strategy's base, changed by the text's length and number of paragraphs."""
    size, paragraphs = len(text_of(n)), sum(1 for _ in n.find("p"))
    c = BASE_CONFIDENCE.get(strategy, 0.5)
    c = min(1.0, c + 0.05) if size > 6000 else c * 0.55 if size < 500 else c
    c = min(1.0, c + 0.04) if paragraphs >= 5 else c * 0.7 if paragraphs <= 1 else c
    return round(c, 3)


def split_breaks(root: Node, least: int = 6) -> None:
    """Where a container parts its text by double line breaks instead of paragraphs, make them paragraphs.

    Only containers with many breaks, few paragraphs and few blocks of other kinds are changed, and
    only if nothing inside them is a block.
    """
    from quire.html.dom import BLOCK

    for n in [x for x in root.walk() if x.tag in ("td", "div", "article", "section", "body")]:
        inner = [x.tag for x in n.walk() if x is not n]
        if inner.count("br") < least or inner.count("p") >= 3 or inner.count("div") + inner.count("table") > 12:
            continue
        if any(t in BLOCK for t in inner):
            continue
        parts: list[list] = [[]]
        gap = 0
        for c in n.children:
            if isinstance(c, Node) and c.tag == "br":
                gap += 1
                continue
            if isinstance(c, str) and gap and not c.strip():
                continue
            if gap:
                if gap > 1:
                    parts.append([])
                else:
                    parts[-1].append(" ")
                gap = 0
            parts[-1].append(c)
        if len(parts) < 2:
            continue
        n.children = []
        for p in parts:
            if any(not isinstance(c, str) or c.strip() for c in p):
                node = Node("p")
                for c in p:
                    node.append(c)
                n.append(node)
