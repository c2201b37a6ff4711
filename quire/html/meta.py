"""Metadata of a page: meta elements in order of trust, then JSON-LD articles."""

from __future__ import annotations

import json
import re
import urllib.parse

from quire.html.dom import Node
from quire.html.select import tidy

# Names of meta elements by field, the first that has a value counts.
FIELDS = {
    "title": ["og:title", "twitter:title", "dc.title"],
    "author": ["author", "article:author", "og:article:author", "dc.creator", "twitter:creator"],
    "published_at": ["article:published_time", "datePublished", "date", "dc.date", "og:published_time", "article:modified_time"],
    "summary": ["description", "og:description", "twitter:description"],
    "site_name": ["og:site_name"],
}
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle")
SEPARATORS = [" - ", " – ", " — ", " — ", " | ", " · ", " :: ", "：", " -"]
HOME_TAILS = [" - 首页", " | 首页", " - Home", " | Home"]


def without_site(title: str, *sites: str) -> str:
    """`title` without a separator and one of the site's names behind it."""
    title = (title or "").strip()
    known = {s.strip() for s in sites if s and s.strip()}
    known |= {k[: -len(h)].strip() for k in known for h in HOME_TAILS if k.endswith(h)} - {""}
    for sep in SEPARATORS:
        for k in sorted(known):
            if title.endswith(sep + k) and len(title) > len(sep + k) + 1:
                return title[: -len(sep + k)].strip()
    return title


def page_meta(root: Node, url: str = "") -> dict[str, str]:
    """The fields a page gives; empty ones are absent."""
    said: dict[tuple[str, str], str] = {}
    for m in root.find("meta"):
        for kind in ("name", "property", "itemprop"):
            v = m.get("content").strip()
            if kind in m.attrs and v:
                said.setdefault((kind, m.get(kind)), v)
    out = {f: next((said[k, n] for n in ns for k in ("name", "property", "itemprop") if (k, n) in said), "") for f, ns in FIELDS.items()}
    heading = next((t.text() for t in root.find("title")), "")
    out["title"] = without_site(out["title"] or tidy(heading), out["site_name"], heading)
    out["language"] = next((h.get("lang").strip() for h in root.find("html")), "")
    for s in root.find("script"):
        if s.get("type") == "application/ld+json":
            _json_ld(s.text(), out)
    if url and not out["site_name"]:
        out["site_name"] = urllib.parse.urlsplit(url).netloc
    return {k: t for k, v in out.items() if (t := tidy(str(v)))}


def _json_ld(text: str, out: dict[str, str]) -> None:
    try:
        data = json.loads(text or "{}")
    except ValueError:
        return
    for x in data if isinstance(data, list) else [data]:
        if not isinstance(x, dict):
            continue
        kind = x.get("@type", "")
        kind = " ".join(map(str, kind)) if isinstance(kind, list) else str(kind)
        if not any(t in kind for t in ARTICLE_TYPES):
            continue
        who = x.get("author")
        who = who[0] if isinstance(who, list) and who else who
        name = who.get("name") if isinstance(who, dict) else who if isinstance(who, str) else None
        for field, v in (("title", x.get("headline")), ("author", name), ("published_at", x.get("datePublished")), ("summary", x.get("description"))):
            if v:
                out[field] = str(v)


_CHARSET = re.compile(rb"charset=[\"']?([\w\-]+)", re.I)


def decode(raw: bytes | str | None) -> str:
    """A page's text: by the charset named in its first 4096 bytes, else UTF-8, GBK or Latin-1."""
    if raw is None or isinstance(raw, str):
        return raw or ""
    m = _CHARSET.search(raw[:4096])
    for name in ([m.group(1).decode("ascii", "ignore")] if m else []) + ["utf-8", "gbk", "latin-1"]:
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")
