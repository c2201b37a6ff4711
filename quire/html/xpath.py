"""The subset of XPath that site configurations use: //a//b, /a, tests on attributes, unions."""

from __future__ import annotations

import re

from quire.html.dom import Node

_STEP = re.compile(r"(//|/)?([\w*-]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"\[\s*(?:contains\(\s*@([\w-]+)\s*,\s*['\"]([^'\"]*)['\"]\s*\)|@([\w-]+)\s*=\s*['\"]([^'\"]*)['\"]|@([\w-]+)|(\d+))\s*\]")


def select(root: Node, path: str) -> list[Node]:
    """The nodes a path names, each once; a path outside the subset names none."""
    out: list[Node] = []
    for part in path.split("|"):
        for n in _one(root, part.strip()):
            if all(n is not m for m in out):
                out.append(n)
    return out


def _one(root: Node, path: str) -> list[Node]:
    at, pos = [root], 0
    path = path.lstrip(".")
    if not path:
        return []
    while pos < len(path):
        m = _STEP.match(path, pos)
        if not m or m.end() == pos:
            return []
        deep, tag, tests = m.group(1) == "//", m.group(2).lower(), m.group(3)
        rest = _TEST.sub("", tests)
        if rest.strip():
            return []
        found = []
        for n in at:
            near = (x for x in n.walk() if x is not n) if deep else iter(n.elements())
            hits = [x for x in near if tag in ("*", x.tag)]
            for t in _TEST.finditer(tests):
                a, has, b, eq, c, nth = t.groups()
                if nth:
                    hits = hits[int(nth) - 1 : int(nth)]
                else:
                    hits = [x for x in hits if (has in x.get(a) if a else x.get(b, "\0") == eq if b else c in x.attrs)]
            found += hits
        at, pos = found, m.end()
    return at
