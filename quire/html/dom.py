"""A tolerant HTML tree on the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, raw-text elements, and what a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}
BLOCK = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "summary",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

_LONG = re.compile(r"&#0*([0-9]{8})[0-9]*|&#0{8,}(?=[0-9])")


class Node:
    """An element; children are Nodes and strings in document order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.elements()))

    def find(self, *tags: str) -> Iterator[Node]:
        want = set(tags)
        return (n for n in self.walk() if n.tag in want and n is not self)

    def strings(self) -> Iterator[str]:
        """All text below, in document order."""
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack.extend(reversed(n.children))

    def text(self) -> str:
        return "".join(self.strings())

    def remove(self) -> None:
        """Take this element out of the tree; text after it stays."""
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            # one of each; repeated ones only add attributes
            for n in self.root.find(tag):
                for k, v in attrs:
                    n.attrs.setdefault(k, v or "")
                return
            if tag == "body":
                self._close("head")
        if tag in BLOCK:
            self._close("p", stop=("td", "th", "li", "blockquote", "div", "table", "body"))
        if tag in CLOSES:
            self._close_any(CLOSES[tag], SCOPE[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.at.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.at.append(Node("br"))
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if data:
            self.at.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # a comment to the next ">", as browsers read it; sections exist in svg and math alone
        if self.rawdata.startswith("<![CDATA[", i) and self._inside("svg", "math"):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def _inside(self, *tags: str) -> bool:
        n = self.at
        while n is not self.root and n.tag not in tags:
            n = n.parent
        return n is not self.root

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        n = self.at
        while n is not self.root:
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag in stop:
                return
            n = n.parent

    def _close_any(self, tags: set[str], scope: set[str]) -> None:
        n = self.at
        top = None
        while n is not self.root and n.tag not in scope:
            if n.tag in tags:
                top = n
            n = n.parent
        if top is not None:
            self.at = top.parent


def parse(html: str | None) -> Node:
    """The tree of `html`; never fails, an empty or NULL page is an empty root."""
    b = _Builder()
    if html:
        try:
            # int() refuses numbers of thousands of digits; eight say as well that there is no such character
            b.feed(_LONG.sub(r"&#\1", html))
            b.close()
        except (AssertionError, ValueError, RecursionError):  # malformed declarations
            pass
    return b.root
