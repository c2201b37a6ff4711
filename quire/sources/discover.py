"""Where articles are: links of pages, sitemaps, feeds, lists of addresses, REST answers."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import url as U
from quire.html.dom import parse
from quire.html.select import prune, text_of

# Page size and most pages of a REST source, rows that make a hint worth while.
PER_PAGE, MAX_PAGES, ENOUGH = 100, 60, 3


def anchors(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(page, pos, url, text): absolute addresses of the links outside boilerplate, without fragments."""

    @F.pandas_udf("array<struct<pos:int,url:string,text:string>>")
    def run(h: pd.Series, base: pd.Series) -> pd.Series:
        def one(page: str | None, b: str | None) -> list[dict]:
            root = parse(page)
            prune(root)
            out = []
            for i, a in enumerate(root.find("a")):
                href = a.get("href").strip()
                if not href or href.startswith(("javascript:", "mailto:", "#", "tel:")):
                    continue
                try:
                    full = urllib.parse.urljoin(b or "", href).split("#")[0]
                except ValueError:
                    continue
                out.append({"pos": i, "url": full, "text": text_of(a)})
            return out

        return pd.Series([one(x, y) for x, y in zip(h, base)], dtype="object")

    return pages.select(F.col(url).alias("page"), F.inline(run(F.col(html), F.col(url))))


def links(found: DataFrame, same_host: bool = True, include: str = "", exclude: str = "", min_hint: int = 0, limit: int = 0) -> DataFrame:
    """(page, url, text, score) of `anchors` that may lead to articles, each once a page.

    Static files, lists, the page itself and, unless told, other hosts are left out. With `min_hint`
    only links of that score stay, where a page has at least three.
    """
    u, page = F.col("url"), F.col("page")
    ok = U.is_http(u) & ~U.is_skipped(u) & (F.regexp_replace(u, "/+$", "") != F.regexp_replace(page, "/+$", ""))
    if same_host:
        ok = ok & (U.netloc(u) == U.netloc(page))
    if include:
        ok = ok & U.matches(u, include)
    if exclude:
        ok = ok & ~U.matches(u, exclude)
    d = found.where(ok).groupBy("page", "url").agg(F.min_by("text", "pos").alias("text")).withColumn("score", U.link_score(F.col("url"), F.col("text")))
    if min_hint:
        # a page's links are a bounded group
        strong = F.sum((F.col("score") >= min_hint).cast("int")).over(W.partitionBy("page"))
        d = d.withColumn("_s", strong).where((F.col("_s") < ENOUGH) | (F.col("score") >= min_hint)).drop("_s")
    if limit:
        d = d.withColumn("_n", F.row_number().over(W.partitionBy("page").orderBy(F.desc("score"), "url"))).where(F.col("_n") <= limit).drop("_n")
    return d


def sitemap_locs(body: Column) -> Column:
    return F.regexp_extract_all(T.or_empty(body), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def is_sitemap_index(body: Column) -> Column:
    return F.lower(T.or_empty(body)).contains("<sitemapindex")


def from_sitemap(bodies: DataFrame | Callable[[DataFrame], DataFrame], start: str | DataFrame, include: str = "", limit: int = 0) -> DataFrame:
    """(url, level, sitemap, pos): the pages of a sitemap and all sitemaps its index names, level by level, each sitemap once.

    `bodies` (url, body) holds the sitemaps at hand, or fetches those of a table (url). The frontier is a table, not a list.
    """
    from quire.session import written

    frontier = start if isinstance(start, DataFrame) else bodies.sparkSession.createDataFrame([(start,)], "url string")
    seen, parts, level = frontier, [], 0
    while level == 0 or not frontier.isEmpty():
        here = bodies(frontier) if callable(bodies) else frontier.join(bodies, "url")
        parts.append(here.where(~is_sitemap_index(F.col("body"))).select(F.col("url").alias("sitemap"), F.lit(level).alias("level"), F.posexplode(sitemap_locs(F.col("body"))).alias("pos", "loc")))
        below = here.where(is_sitemap_index(F.col("body"))).select(F.explode(sitemap_locs(F.col("body"))).alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = written(below, "sitemaps")
        seen = seen.unionByName(frontier)
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(F.col("loc").alias("url"), "level", "sitemap", "pos").where(U.matches(F.col("url"), include))
    return out.orderBy("level", "sitemap", "pos").limit(limit) if limit else out


def feed_links(body: Column) -> Column:
    """Links of a feed: link elements, link attributes, guids, each address once."""
    b = T.or_empty(body)
    kinds = [r"(?i)<link>\s*(https?://[^<\s]+)\s*</link>", r"""(?i)<link[^>]+href=["'](https?://[^"']+)["']""", r"(?i)<guid[^>]*>\s*(https?://[^<\s]+)\s*</guid>"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(b, F.lit(k), F.lit(1)) for k in kinds]))


def from_feed(bodies: DataFrame, limit: int = 0) -> DataFrame:
    """(feed, pos, url) of feeds (url, body)."""
    found = feed_links(F.col("body"))
    found = F.slice(found, 1, limit) if limit else found
    return bodies.select(F.col("url").alias("feed"), F.posexplode(found).alias("pos", "url"))


def is_feed(body: Column) -> Column:
    h = F.lower(F.substring(T.or_empty(body), 1, 1200))
    return h.contains("<rss") | h.contains("<feed") | h.contains("<rdf:rdf") | (h.contains("<?xml") & h.contains("<channel"))


def is_sitemap(body: Column) -> Column:
    h = F.lower(F.substring(T.or_empty(body), 1, 1200))
    return h.contains("<urlset") | h.contains("<sitemapindex")


def from_urls_file(spark: SparkSession, path: str) -> DataFrame:
    """(url, seq) of a file with an address a line; lines with # are comments. `seq` grows with the place in the file."""
    lines = spark.read.text(path).select(T.strip(F.col("value")).alias("url"), F.monotonically_increasing_id().alias("seq"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def resolve(*parts: DataFrame, limit: int = 0) -> DataFrame:
    """(url, section, seq): the union of sources (url, section, seq), in their order, the first of each address."""
    from quire.operators.articles import first_per_url
    from quire.operators.ranking import row_numbers

    all_ = None
    for i, p in enumerate(parts):
        q = p.select("url", "section", F.struct(F.lit(i).alias("source"), F.col("seq").cast("long").alias("n")).alias("seq"))
        all_ = q if all_ is None else all_.unionByName(q)
    out = row_numbers(first_per_url(all_), [], ["seq"], "_n").select("url", "section", F.col("_n").alias("seq"))
    return out.where(F.col("seq") <= limit) if limit else out


POST = "array<struct<id:int,link:string,date:string,title:struct<rendered:string>,categories:array<int>,tags:array<int>>>"
CATEGORY = "array<struct<id:int,slug:string,name:string,parent:int,count:int,description:string>>"


def api_root(site: str) -> str:
    """The REST root of a site, whatever path it was given with."""
    p = urllib.parse.urlsplit(site if "://" in site else f"https://{site}")
    return f"{p.scheme}://{p.netloc}/wp-json/wp/v2"


def rest_pages(get: Callable[[str], str | None], site: str, what: str, fields: str, per_page: int = PER_PAGE, max_pages: int = MAX_PAGES) -> list[str]:
    """The JSON answers of a paged REST source: until one is missing, no list, empty or short. Asks for `fields` only."""
    import json

    out = []
    for n in range(1, max_pages + 1):
        body = get(f"{api_root(site)}/{what}?per_page={per_page}&page={n}&_fields={fields}")
        try:
            rows = json.loads(body) if body else None
        except ValueError:
            rows = None
        if not isinstance(rows, list) or not rows:
            break
        out.append(body)
        if len(rows) < per_page:
            break
    return out


def rest_rows(answers: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """The rows of JSON answers; unknown keys are dropped, bad answers give none."""
    return answers.where(F.col(body).rlike(r"^\s*\[")).select(F.inline(F.from_json(body, kind)))


def detect(probes: DataFrame) -> DataFrame:
    """`probes` (url, adapter, api, feed, sitemap) with kind: adapter, wordpress, feed, sitemap or list.

    Each probe column holds what was found, NULL or '' if nothing was.
    """
    def has(c: str) -> Column:
        return T.or_empty(F.col(c)) != ""

    return probes.withColumn("kind", F.when(has("adapter"), "adapter").when(has("api"), "wordpress").when(has("feed"), "feed").when(has("sitemap"), "sitemap").otherwise("list"))


def is_wordpress(root: Column, posts: Column) -> Column:
    """Whether a REST root answers with the namespace and its posts with a list."""
    ns = F.from_json(T.or_empty(root), "namespaces array<string>")["namespaces"]
    return F.coalesce(F.array_contains(ns, "wp/v2"), F.lit(False)) & F.from_json(T.or_empty(posts), "array<struct<id:int>>").isNotNull()


def feed_candidates(html: Column, url: Column) -> Column:
    """Feeds a page names, then the usual paths of its site."""
    h = T.or_empty(html)
    tag = F.regexp_extract(h, r"""(?i)<link[^>]+type=["']application/(?:rss|atom)\+xml["'][^>]*>""", 0)
    href = F.regexp_extract(tag, r"""(?i)href=["']([^"']+)["']""", 1)
    named = F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(U.origin(url), href))
    return F.array_distinct(F.array_compact(F.concat(F.array(named), F.array(*[F.concat(U.origin(url), F.lit(p)) for p in U.FEED_PATHS]))))


def sitemap_candidates(robots: Column, url: Column) -> Column:
    """Sitemaps robots.txt names, then the usual paths; packed ones are left out."""
    named = F.regexp_extract_all(T.or_empty(robots), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    usual = F.array(*[F.concat(U.origin(url), F.lit(p)) for p in U.SITEMAP_PATHS])
    return F.array_distinct(F.filter(F.concat(named, usual), lambda x: ~x.endswith(".gz")))
