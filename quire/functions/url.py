"""Address functions as Column expressions."""

from __future__ import annotations

import re
import urllib.parse
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import clean_text, or_empty

# Addresses that are no articles, and such as look like them.
SKIP_LINK = (
    r"(?i)\.(?:pdf|zip|rar|7z|tar|gz|exe|dmg|mp4|mp3|mov|avi|css|js|json|xml|ico|woff2?|ttf|otf)"
    r"|/(?:tag|tags|category|categories|author|page|search|login|signup|subscribe|feed|rss|about|contact|privacy|terms|archive|donate|shop|cart)(?:/|$)"
    r"|^(?:mailto:|javascript:|#)"
)
ARTICLE_HINT = r"(?i)/\d{4}/\d{1,2}/|/posts?/|/articles?/|/essays?/|/blog/|/\d{4}/|/p/|/notes?/|\d{4}-\d{2}-\d{2}|\.html?$"
ROOT_TITLE = "根目录"
IMAGE_REJECT = r"^(?:data:|file:|[A-Za-z]:[\\/]|\\\\)"
MIME_BY_EXT = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "svg": "image/svg+xml", "avif": "image/avif", "css": "text/css", "xhtml": "application/xhtml+xml",
}
FEED_PATHS = ["/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml", "/rss/index.xml", "/feed/atom"]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml"]


def url_key(c: Column) -> Column:
    """The address without its fragment; everything else counts."""
    return F.substring_index(or_empty(c), "#", 1)


def netloc(c: Column) -> Column:
    """Host with port, as written."""
    return F.regexp_extract(or_empty(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def origin(c: Column) -> Column:
    return F.regexp_extract(or_empty(c), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def site(c: Column) -> Column:
    """The host in lower case without port, user and leading www."""
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(c), r"^[^@]*@", ""), r":\d*$", ""))
    return F.regexp_replace(host, r"^www\.", "")


def path_segment(c: Column) -> Column:
    """The first segment of the path, '' if there is none."""
    return F.regexp_extract(or_empty(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/*([^/?#]*)", 1)


def title_from_path(c: Column) -> Column:
    """The first path segment, decoded, as up to 24 characters of title."""
    raw = path_segment(c)
    # a plus is itself, and a segment that can't be decoded stays as it is
    raw = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    t = F.substring(clean_text(F.translate(raw, "-_", "  ")), 1, 24)
    return F.when(t != "", t).otherwise(ROOT_TITLE)


def is_http(c: Column) -> Column:
    return or_empty(c).rlike(r"^https?://")


def is_skipped(c: Column) -> Column:
    return or_empty(c).rlike(SKIP_LINK)


def has_article_hint(c: Column) -> Column:
    return or_empty(c).rlike(ARTICLE_HINT)


def matches(c: Column, pattern: str, case: bool = False) -> Column:
    """Search anywhere, without regard to case unless told; an empty pattern matches everything."""
    if not pattern:
        return F.lit(True)
    return or_empty(c).rlike(pattern if case else f"(?i){pattern}")


def link_score(url: Column, text: Column) -> Column:
    """How much a link looks like one to an article: hint 3, longer text 2 and 1 more, shallow path 1."""
    slashes = F.regexp_count(F.regexp_replace(or_empty(url), "/+$", ""), F.lit("/"))
    n = F.length(text)
    return (
        F.when(has_article_hint(url), 3).otherwise(0) + F.when(n >= 12, 2).otherwise(0) + F.when(n >= 25, 1).otherwise(0) + F.when(slashes <= 2, 1).otherwise(0)
    )


def is_image_source(c: Column) -> Column:
    return (or_empty(c) != "") & ~or_empty(c).rlike(IMAGE_REJECT)


def mime_of(c: Column) -> Column:
    ext = F.lower(F.regexp_extract(or_empty(c), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME_BY_EXT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def image_sources(c: Column) -> Column:
    """What images of a Markdown or HTML text are named by, in order of form and place, each once."""
    c = or_empty(c)
    md = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    tags = F.regexp_extract_all(c, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)"""), F.lit(1))
    lazy = F.regexp_extract_all(c, F.lit(r"""(?i)\b(?:src|data-src|data-original)=["']([^"']+\.(?:jpg|jpeg|png|gif|webp|svg|avif))["']"""), F.lit(1))
    return F.array_distinct(F.concat(md, tags, lazy))


def image_urls(c: Column, base: Column | None = None) -> Column:
    """Absolute addresses of a text's images, each once; with the page's own as `base`, relative ones are joined to it."""
    found = image_sources(c)
    return F.filter(F.array_distinct(F.transform(image_refs(found, base), lambda x: x["url"])) if base is not None else found, is_http)


def image_refs(sources: Column, base: Column) -> Column:
    """array<struct<src, url>>: each source with its absolute address, by Arrow batches, as Catalyst can't join addresses."""

    @F.pandas_udf("array<struct<src:string,url:string>>")
    def run(s: pd.Series, b: pd.Series) -> pd.Series:
        def full(x: str, at: str | None) -> str:
            try:
                return urllib.parse.urljoin(at or "", x)
            except ValueError:
                return x

        return pd.Series([[{"src": x, "url": full(x, at)} for x in (xs if xs is not None else [])] for xs, at in zip(s, b)], dtype="object")

    return run(sources, base)


def title_of_url(c: Column) -> Column:
    """A title made of an address: the name of its last part without extension, or of its host, in words."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(u: str | None) -> str:
            try:
                p = urllib.parse.urlsplit(u or "")
            except ValueError:
                return u or ""
            name = PurePosixPath(p.path).stem or p.netloc
            return re.sub("[-_]+", " ", name).strip().title() or (u or "")

        return s.map(one)

    return run(c)
