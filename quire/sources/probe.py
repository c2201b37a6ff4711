"""What a site is: adapter, REST interface, feed, sitemap or a list of links, asked in that order."""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.functions.url import FEED_PATHS, SITEMAP_PATHS
from quire.html.dom import parse
from quire.html.select import tidy
from quire.sources.adapters import Registry

Get = Callable[[str], str | None]


@dataclass
class SiteProfile:
    """The answers; kind is adapter, wordpress, feed, sitemap, list or unknown."""

    url: str
    kind: str = "unknown"
    title: str = ""
    author: str = ""
    description: str = ""
    language: str = ""
    entry_urls: list[str] = field(default_factory=list)
    feed_url: str = ""
    sitemap_url: str = ""
    api_root: str = ""
    adapter: str = ""
    notes: list[str] = field(default_factory=list)


def _is_feed(text: str | None) -> bool:
    h = (text or "")[:1200].lower()
    return "<rss" in h or "<feed" in h or "<rdf:rdf" in h or ("<?xml" in h and "<channel" in h)


def _is_sitemap(text: str | None) -> bool:
    h = (text or "")[:1200].lower()
    return "<urlset" in h or "<sitemapindex" in h


def find_api(get: Get, base: str) -> tuple[str, dict] | None:
    """(root, what it says) of a REST interface whose posts can be listed."""
    for path in ("/wp-json/", "/?rest_route=/"):
        try:
            info = json.loads(get(base + path) or "")
            posts = json.loads(get(f"{base}/wp-json/wp/v2/posts?per_page=1&_fields=id") or "")
        except ValueError:
            continue
        if isinstance(info, dict) and "wp/v2" in (info.get("namespaces") or []) and isinstance(posts, list):
            return f"{base}/wp-json/wp/v2", info
    return None


def find_feed(get: Get, base: str, html: str) -> str:
    root = parse(html)
    named = [urllib.parse.urljoin(base + "/", n.get("href")) for n in root.find("link") if "alternate" in n.get("rel").lower() and ("rss" in n.get("type") or "atom" in n.get("type")) and n.get("href")]
    return next((u for u in [*named, *(base + p for p in FEED_PATHS)] if _is_feed(get(u))), "")


def find_sitemap(get: Get, base: str) -> str:
    named = re.findall(r"(?im)^\s*sitemap:\s*(\S+)", get(f"{base}/robots.txt") or "")
    return next((u for u in [*named, *(base + p for p in SITEMAP_PATHS)] if not u.endswith(".gz") and _is_sitemap(get(u))), "")


def read_meta(html: str, p: SiteProfile) -> None:
    """Title, description, author and language of the front page, where it gives them."""
    root = parse(html)
    said = {}
    for m in root.find("meta"):
        for k in ("name", "property"):
            if m.get(k) and m.get("content").strip():
                said.setdefault(m.get(k).lower(), tidy(m.get("content")))
    title = next((said[k] for k in ("og:site_name", "application-name", "twitter:title") if k in said), "") or next((tidy(t.text()) for t in root.find("title")), "")
    home = re.sub(r"\s*[-|–—·:：]\s*(首页|主页|Home|home|Homepage)\s*$", "", title)
    p.title = p.title or (re.sub(r"\s*[-|–—]\s*[^-|–—]{0,40}$", "", home) if "|" in home else home).strip() or title
    p.description = p.description or said.get("description", said.get("og:description", ""))
    p.author = p.author or next((said[k] for k in ("author", "article:author", "og:article:author") if k in said), "")
    lang = next((h.get("lang") for h in root.find("html")), "").split("-")[0].lower()
    p.language = p.language or ("zh-CN" if lang == "zh" else lang)


def probe(get: Get, url: str, registry: Registry | None = None, sitemap: bool = True) -> SiteProfile:
    """The profile of a site; `get` gives a page's text or None, and may fail."""

    def safe(u: str) -> str | None:
        try:
            return get(u)
        except Exception as e:  # noqa: BLE001  what can't be asked isn't there
            p.notes.append(f"{u}: {type(e).__name__}")
            return None

    p = SiteProfile(url)
    parts = urllib.parse.urlsplit(url)
    base = f"{parts.scheme}://{parts.netloc}"
    html = safe(url) or ""
    read_meta(html, p)
    adapter = registry.find(url) if registry else None
    api = find_api(safe, base)
    if api:
        p.api_root = api[0]
        p.title = p.title or tidy(str(api[1].get("name") or ""))
        p.description = p.description or tidy(str(api[1].get("description") or ""))
    if adapter is not None:
        p.kind, p.adapter, p.entry_urls = "adapter", adapter.name, adapter.entry_urls(base) or [url]
    elif api:
        p.kind = "wordpress"
    elif feed := find_feed(safe, base, html):
        p.kind, p.feed_url, p.entry_urls = "feed", feed, [feed]
    elif sitemap and (found := find_sitemap(safe, base)):
        p.kind, p.sitemap_url, p.entry_urls = "sitemap", found, [found]
    else:
        p.kind, p.entry_urls = "list", [url]
    return p
