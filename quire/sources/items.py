"""Items to fetch, gathered from lists, sitemaps, feeds, entry pages and REST sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import written
from quire.sources import discover as D
from quire.sources import fetch as FE

#: Links an entry page must have to count as a list of articles.
LIST_FROM = 2
ITEM = "url string, section string, seq long"
# Addresses that name a sitemap or a feed.
SITEMAP_ADDRESS, FEED_ADDRESS = r"(?i)\.xml$|sitemap", r"(?i)\.rss$|\.atom$|/feed/?$|/rss/?$|rss\.html$|feed"


def kind_of(address: Column, body: Column) -> Column:
    """sitemap, feed or page: by the address, where the body doesn't tell otherwise."""
    told = F.when(D.is_sitemap(body), "sitemap").when(D.is_feed(body) & (F.size(D.feed_links(body)) > 0), "feed")
    named = F.when(address.rlike(SITEMAP_ADDRESS) & ~address.rlike(r"(?i)feed|rss|atom"), "sitemap").when(address.rlike(FEED_ADDRESS) & (F.size(D.feed_links(body)) > 0), "feed")
    return F.coalesce(told, named, F.lit("page"))


def gather(spark: SparkSession, transport: FE.Transport, urls_file: str = "", sitemaps: list[str] = (), feeds: list[str] = (), entries: list[str] = (), same_host: bool = True, include: str = "", exclude: str = "", limit: int = 0, **pace) -> DataFrame:
    """(url, section, seq) of all sources in this order, each address once, at most `limit` of them.

    Entries are dispatched by what they are: a sitemap, a feed, a page with links, or, with fewer than
    LIST_FROM links, an article itself. `section` is urls-file, sitemap, feed, the entry page, or single.
    """

    def bodies(urls: DataFrame) -> DataFrame:
        got = FE.fetch(urls, transport, **pace).where("ok")
        return written(got.select("url", F.coalesce(F.nullif("text", F.lit("")), F.decode("content", "UTF-8")).alias("body")), "sources")

    def listed(names: list[str]) -> DataFrame:
        return spark.createDataFrame([(u.strip(), n) for n, u in enumerate(names) if u.strip()], "url string, nth long")

    parts = []
    if urls_file:
        parts.append(D.from_urls_file(spark, urls_file).select("url", F.lit("urls-file").alias("section"), "seq"))
    asked = listed(list(entries))
    pages = asked.join(bodies(asked.select("url")), "url").withColumn("kind", kind_of(F.col("url"), F.col("body")))
    maps = listed(list(sitemaps)).select("url").unionByName(pages.where("kind = 'sitemap'").select("url"))
    if sitemaps or entries:
        found = D.from_sitemap(bodies, maps.distinct(), include)
        parts.append(_numbered(found, "sitemap", ["level", "sitemap", "pos"]))
    if feeds or entries:
        told = bodies(listed(list(feeds)).select("url")) if feeds else pages.select("url", "body").limit(0)
        parts.append(_numbered(D.from_feed(told.unionByName(pages.where("kind = 'feed'").select("url", "body"))), "feed", ["feed", "pos"]))
    if entries:
        plain = pages.where("kind = 'page'")
        links = written(D.links(D.anchors(plain, "body"), same_host, include, exclude), "links")
        many = links.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") >= LIST_FROM).select("page")
        rows = links.join(many, "page", "left_semi").select("url", F.col("page").alias("section"), "page", F.col("score").cast("long").alias("score"))
        single = plain.join(many, plain.url == many.page, "left_anti").select("url", F.lit("single").alias("section"), F.col("url").alias("page"), F.lit(0).cast("long").alias("score"))
        both = rows.unionByName(single).join(asked.select(F.col("url").alias("page"), "nth"), "page")
        from quire.operators.ranking import row_numbers

        parts.append(row_numbers(both, [], ["nth", ("score", "desc"), "url"], "seq").select("url", "section", "seq"))
    return D.resolve(*parts, limit=limit) if parts else spark.createDataFrame([], ITEM)


def _numbered(found: DataFrame, section: str, order: list[str]) -> DataFrame:
    from quire.operators.ranking import row_numbers

    return row_numbers(found, [], order, "seq").select("url", F.lit(section).alias("section"), "seq")


def from_rest(spark: SparkSession, transport: FE.Transport, site: str) -> tuple[DataFrame, DataFrame]:
    """(categories, posts) of a site's REST interface, as the plans take them."""

    def get(url: str) -> str | None:
        a = transport(url)
        return (a.text or a.content.decode("utf-8", "replace")) if a.status == 200 else None

    host = site.split("://")[-1].split("/")[0]
    answers = {w: spark.createDataFrame([(b,) for b in D.rest_pages(get, site, w, f)], "body string") for w, f in (("categories", "id,slug,name,parent,count,description"), ("posts", "id,link,date,title,categories,tags"))}
    c = D.rest_rows(answers["categories"], D.CATEGORY).select("id", F.lit(host).alias("site"), "name", "slug", "parent", F.col("count").alias("n_posts"), "description")
    p = D.rest_rows(answers["posts"], D.POST).select(
        "id", F.lit(host).alias("site"), "link", T.or_empty(F.col("title.rendered")).alias("title"), F.col("date").alias("date_str"), "categories",
        F.lit(None).cast("timestamp").alias("modified_at"), F.lit(None).cast("timestamp").alias("loaded_at"),
    )
    return written(c, "rest-categories"), written(p, "rest-posts")
