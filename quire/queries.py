"""The registered queries of the core, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.book import cover, toc, typeset
from quire.functions import text as T
from quire.functions import url as U
from quire.operators import articles as A
from quire.operators import chunks as C
from quire.operators import extract as X
from quire.operators import hierarchy
from quire.operators import titles as TT
from quire.plans import grouping as G
from quire.plans import taxonomy as TX
from quire.session import table, written
from quire.sources import adapters as AD
from quire.sources import discover as D
from quire.sources import fetch as FE
from quire.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# SQL for a character class and for white space as the functions see them
_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(x: str) -> str:
    x = f"replace(replace(coalesce({x}, ''), chr(8203), ''), chr(65279), '')"
    return _strip(f"regexp_replace(regexp_replace({x}, '[ \\t\\x{{a0}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _words(x: str) -> str:
    return f"(len(regexp_extract_all(coalesce({x}, ''), '{_CJK}')) + len(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+(?:[''\\-][A-Za-z0-9]+)*')))"


def _site(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':\\d*$', '')), '^www\\.', '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- hierarchies

_TREE = """WITH RECURSIVE n AS (
  SELECT id, min(site) AS site, min(coalesce(nullif(trim(slug), ''), '#' || id)) AS slug, min(coalesce(parent, 0)) AS parent
  FROM categories WHERE id IS NOT NULL GROUP BY id),
r AS (
  SELECT id, slug AS path, 1 AS depth, id AS root, [id] AS line FROM n WHERE parent = 0 OR parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, r.path || '/' || n.slug, r.depth + 1, r.root, list_append(r.line, n.id) FROM n JOIN r ON n.parent = r.id AND n.parent <> 0)"""
_WALK = """, w AS (
  SELECT id, parent AS nx, id AS low FROM n WHERE id NOT IN (SELECT id FROM r)
  UNION SELECT w.id, n.parent, least(w.low, n.id) FROM w JOIN n ON n.id = w.nx WHERE w.nx <> w.id),
c AS (SELECT id, min(low) FILTER (nx = id) AS cycle_id FROM w GROUP BY id HAVING bool_or(nx = id))"""


def _forest(spark: SparkSession, sf_dir: str) -> hierarchy.Hierarchy:
    return hierarchy.build(table(spark, sf_dir, "categories"))


@query(_TREE + _WALK + " SELECT CAST(id AS INTEGER) AS id, CAST(cycle_id AS INTEGER) AS cycle_id FROM c")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cycle_id) of the categories that reach themselves by their parents."""
    return _forest(spark, sf_dir).cycles.selectExpr("int(id) AS id", "int(cycle_id) AS cycle_id")


@query(_TREE + _WALK + """, d AS (SELECT line[i] AS id, count(*) AS n FROM (SELECT line, unnest(range(1, len(line))) AS i FROM r) GROUP BY 1)
SELECT n.id, n.site, n.parent, CASE WHEN c.id IS NOT NULL THEN 'cycle' WHEN r.depth IS NULL THEN 'behind_cycle' WHEN r.depth > 1 THEN 'child' WHEN n.parent = 0 THEN 'root' ELSE 'orphan' END AS state,
  r.path, r.depth, r.root, c.cycle_id, coalesce(d.n, 0) AS n_descendants FROM n LEFT JOIN r ON r.id = n.id LEFT JOIN c ON c.id = n.id LEFT JOIN d ON d.id = n.id""")
def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root, state and number of descendants of every category."""
    h = _forest(spark, sf_dir)
    return h.paths().join(h.n_descendants(), "id", "left").na.fill(0, ["n_descendants"])


@query(_TREE + " SELECT line[len(line) - g.d] AS ancestor, id AS descendant, CAST(g.d AS INTEGER) AS distance FROM r, LATERAL (SELECT unnest(range(1, len(line))) AS d) g")
def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of the category forest."""
    return _forest(spark, sf_dir).descendants()


# -- scalar functions

@query(f"SELECT doc_id, CAST({_words('text')} AS BIGINT) AS words FROM documents")
def q_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, CAST(greatest(1, round_even({_words('text')} / (CASE WHEN coalesce(lang, '') LIKE 'zh%' THEN 400.0 ELSE 230.0 END), 0)) AS BIGINT) AS minutes FROM documents")
def q_reading_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.reading_minutes(T.count_words(F.col("text")), F.col("lang")).alias("minutes"))


@query(r"""SELECT DISTINCT extract_id, CASE WHEN c > 0.25 * (c + l) THEN 'zh' ELSE 'en' END AS guess FROM (
  SELECT extract_id, len(regexp_extract_all(h, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]')) AS c, len(regexp_extract_all(h, '[A-Za-z]')) AS l FROM (SELECT extract_id, substring(coalesce(markdown, ''), 1, 4000) AS h FROM extracts))""")
def q_guess_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracts").select("extract_id", T.guess_language(F.col("markdown")).alias("guess")).distinct()


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) / greatest(length(coalesce(text, '')), 1) AS ratio FROM documents")
def q_cjk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.cjk_ratio(F.col("text")).alias("ratio"))


@query(f"SELECT DISTINCT article_no, {_clean('title')} AS clean FROM articles")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("article_no", T.clean_text(F.col("title")).alias("clean")).distinct()


@query("SELECT DISTINCT fetch_id, md5(" + _clean("regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')") + ") AS digest FROM fetches")
def q_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fetches").select("fetch_id", F.md5(T.strip_tags(F.col("text"))).alias("digest")).distinct()


@query("SELECT DISTINCT fetch_id, CASE WHEN n < 1024 THEN format('{:d} B', n) ELSE format('{:.1f} KB', n / 1024.0::DOUBLE) END AS size FROM (SELECT fetch_id, octet_length(content) AS n FROM fetches WHERE content IS NOT NULL)")
def q_human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fetches").where("content IS NOT NULL")
    return f.select("fetch_id", T.human_size(F.length("content")).alias("size")).distinct()


@query("SELECT doc_id, substring(sha1(coalesce(text, '')), 1, 8) AS hash FROM documents")
def q_short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.short_hash(F.col("text")).alias("hash"))


@query(r"""WITH d AS (SELECT DISTINCT id, """ + _strip("coalesce(date_str, '')") + r""" AS s FROM posts)
SELECT id, CASE WHEN regexp_matches(s, '(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})') THEN regexp_extract(s, '(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', 1) || '-' || lpad(regexp_extract(s, '(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(s, '(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', 3), 2, '0')
  WHEN regexp_matches(s, '(\d{4})[-/.](\d{1,2})') THEN regexp_extract(s, '(\d{4})[-/.](\d{1,2})', 1) || '-' || lpad(regexp_extract(s, '(\d{4})[-/.](\d{1,2})', 2), 2, '0')
  ELSE coalesce(strftime(coalesce(try_strptime(s, '%B %d, %Y'), try_strptime(s, '%b %d, %Y'), try_strptime(s, '%d %B %Y'), try_strptime(s, '%Y')), '%Y-%m-%d'), s) END AS date FROM d""")
def q_normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "posts").select("id", T.normalize_date(F.col("date_str")).alias("date")).distinct()


@query(r"""WITH a AS (SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9_\s\-]', '', 'g'), '[\s_]+', '-', 'g')), '-') AS s FROM part)
SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' ELSE rtrim(substring(regexp_replace(s, '-{2,}', '-', 'g'), 1, 60), '-') END AS slug FROM a""")
def q_slug_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug_ascii(F.col("p_name")).alias("slug"))


@query()
def q_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug and file name of every title, in any script."""
    a = table(spark, sf_dir, "articles").select("article_no", "title").distinct()
    return a.select("article_no", T.slugify(F.col("title"), 48).alias("slug"), T.safe_filename(F.col("title"), 80, ".md").alias("file_name"))


@query(f"SELECT DISTINCT article_no, split_part(source_url, '#', 1) AS key, {_site('source_url')} AS site, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS netloc, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*/*([^/?#]*)', 1) AS segment FROM articles")
def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, sf_dir, "articles").select("article_no", U.url_key(u).alias("key"), U.site(u).alias("site"), U.netloc(u).alias("netloc"), U.path_segment(u).alias("segment")).distinct()


_HINT = r"(?i)/\d{4}/\d{1,2}/|/posts?/|/articles?/|/essays?/|/blog/|/\d{4}/|/p/|/notes?/|\d{4}-\d{2}-\d{2}|\.html?$"


@query(f"""SELECT DISTINCT article_no, CAST((CASE WHEN regexp_matches(source_url, '{_HINT}') THEN 3 ELSE 0 END) + (CASE WHEN length(title) >= 12 THEN 2 ELSE 0 END) + (CASE WHEN length(title) >= 25 THEN 1 ELSE 0 END)
  + (CASE WHEN length(rtrim(source_url, '/')) - length(replace(rtrim(source_url, '/'), '/', '')) <= 2 THEN 1 ELSE 0 END) AS INTEGER) AS score,
  regexp_matches(source_url, '{U.SKIP_LINK}') AS skipped FROM articles""")
def q_link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.select("article_no", U.link_score(F.col("source_url"), F.col("title")).alias("score"), U.is_skipped(F.col("source_url")).alias("skipped")).distinct()


@query()
def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in every extract's page that may lead to articles, with their scores."""
    e = table(spark, sf_dir, "extracts").groupBy("url").agg(F.max("markdown").alias("markdown"))
    return D.links(D.anchors(e.select("url", typeset.chapters(F.lit(""), F.col("markdown")).alias("html"))), same_host=False)


@query(r"SELECT extract_id, url, count(*) AS n FROM (SELECT extract_id, unnest(regexp_extract_all(markdown, '\]\((https?://[^)\s]+)', 1)) AS url FROM (SELECT DISTINCT extract_id, markdown FROM extracts)) GROUP BY 1, 2")
def q_links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracts").select("extract_id", "markdown").distinct()
    links = F.regexp_extract_all("markdown", F.lit(r"\]\((https?://[^)\s]+)"), F.lit(1))
    return e.select("extract_id", F.explode(links).alias("url")).groupBy("extract_id", "url").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT fetch_id, " + _clean("regexp_replace(regexp_extract(coalesce(text, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')") + " AS page_title FROM fetches")
def q_page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_titles(table(spark, sf_dir, "fetches").select("fetch_id", F.col("text").alias("html"))).select("fetch_id", "page_title").distinct()


@query(r"""SELECT url, lower(h) LIKE '%<rss%' OR lower(h) LIKE '%<feed%' OR lower(h) LIKE '%<rdf:rdf%' OR (lower(h) LIKE '%<?xml%' AND lower(h) LIKE '%<channel%') AS feed, lower(h) LIKE '%<urlset%' OR lower(h) LIKE '%<sitemapindex%' AS sitemap
  FROM (SELECT DISTINCT url, substring(coalesce(text, ''), 1, 1200) AS h FROM fetches WHERE ok)""")
def q_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are feeds or sitemaps."""
    f = table(spark, sf_dir, "fetches").where("ok").select("url", F.substring(T.or_empty(F.col("text")), 1, 1200).alias("h")).distinct()
    return f.select("url", D.is_feed(F.col("h")).alias("feed"), D.is_sitemap(F.col("h")).alias("sitemap"))


# -- plans

_POSTS = "(SELECT DISTINCT id, " + _strip("link") + " AS url, coalesce(date_str, '') AS date, categories, coalesce(site, '') AS site FROM posts WHERE id IS NOT NULL AND " + _strip("coalesce(link, '')") + " <> '')"
_ENTRIES = f"(SELECT id AS seq, url, date FROM {_POSTS} WHERE regexp_matches(url, '^https?://'))"
_YEAR = "regexp_extract(" + _strip("date") + r", '^(\d{4})', 1)"
_PLAN_END = "CAST(1 AS BIGINT) AS section_no, '' AS section_title, '' AS section_slug"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TX.site_entries(table(spark, sf_dir, "posts"))


@query(f"""WITH e AS (SELECT *, CASE WHEN {_YEAR} <> '' THEN {_YEAR} ELSE '未标日期' END AS t FROM {_ENTRIES}),
p AS (SELECT t, row_number() OVER (ORDER BY CASE WHEN t = '未标日期' THEN '~' ELSE t END) AS part_no FROM (SELECT DISTINCT t FROM e))
SELECT p.part_no, t AS part_title, CASE WHEN t = '未标日期' THEN 'undated' ELSE 'y' || t END AS part_slug, {_PLAN_END}, url,
  row_number() OVER (PARTITION BY t ORDER BY CASE WHEN t = '未标日期' THEN '' ELSE date END, CASE WHEN t = '未标日期' THEN '' ELSE url END, seq) AS pos FROM e JOIN p USING (t)""")
def q_group_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.by_date(_entries(spark, sf_dir))


@query(f"""WITH e AS (SELECT *, substring({_clean("translate(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*/*([^/?#]*)', 1), '-_', '  ')")}, 1, 24) AS t0 FROM {_ENTRIES}),
f AS (SELECT *, CASE WHEN t0 = '' THEN '根目录' ELSE t0 END AS t FROM e), p AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) AS part_no FROM f GROUP BY t)
SELECT p.part_no, t AS part_title, url, row_number() OVER (PARTITION BY t ORDER BY date, url, seq) AS pos FROM f JOIN p USING (t)""")
def q_group_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.by_path(_entries(spark, sf_dir)).select("part_no", "part_title", "url", "pos")


@query(f"SELECT url, row_number() OVER (ORDER BY date, url, seq) AS pos FROM {_ENTRIES}")
def q_group_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.by_flat(_entries(spark, sf_dir)).select("url", "pos")


_CATS = "c AS (SELECT id, min(coalesce(site, '')) AS site, min(coalesce(slug, '')) AS slug, min(coalesce(name, '')) AS name, min(coalesce(parent, 0)) AS parent, min(coalesce(n_posts, 0)) AS n_posts FROM categories WHERE id IS NOT NULL GROUP BY id)"
_DEPTH = f"""WITH RECURSIVE {_CATS}, w AS (SELECT id, parent, 0 AS d FROM c UNION ALL SELECT w.id, coalesce(c.parent, 0), d + 1 FROM w LEFT JOIN c ON c.id = w.parent WHERE w.parent <> 0 AND d < 32),
depth AS (SELECT id, max(d) AS depth FROM w GROUP BY id)"""
_TOP = """, t AS (SELECT id, id AS top, 0 AS d FROM c UNION ALL SELECT t.id, p.id, d + 1 FROM t JOIN c AS q ON q.id = t.top JOIN c AS p ON p.id = q.parent WHERE q.parent <> 0 AND d < 12),
top AS (SELECT id, max(d) AS steps, arg_max(top, d) AS top FROM t GROUP BY id)"""
_PRIORITY = ", pr AS (SELECT site, id, slug, row_number() OVER (PARTITION BY site ORDER BY depth DESC, n_posts, id) AS priority FROM c JOIN depth USING (id) WHERE slug <> '')"
_THEMES = """, tops AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n_posts) - 1 AS k, count(*) OVER (PARTITION BY site) AS n FROM c WHERE parent = 0),
m AS (SELECT site, max(n) AS n, max(n_posts) FILTER (k = n // 2) AS median, max(n_posts) AS most, arg_max(id, n_posts * 100000000.0 - id) AS big FROM tops GROUP BY site),
th AS (SELECT tops.site, id, slug, row_number() OVER (PARTITION BY tops.site ORDER BY (id = big)::INT, id) AS theme_no FROM tops JOIN m ON m.site = tops.site WHERE m.n > 1 AND median > 0 AND most > 2.5 * median)"""
_PICK = f""", e AS (SELECT DISTINCT p.id, p.site, unnest(p.categories) AS category FROM {_POSTS} p), sl AS (SELECT site, slug, min(priority) AS priority FROM pr GROUP BY 1, 2),
pick AS (SELECT id, site, category, top, steps FROM (SELECT e.id, e.site, category, top, steps, row_number() OVER (PARTITION BY e.id ORDER BY steps DESC, coalesce(sl.priority, 1099511627776), category) AS k
  FROM e JOIN c ON c.id = category JOIN top ON top.id = category LEFT JOIN sl ON sl.site = c.site AND sl.slug = c.slug) WHERE k = 1)"""


@query(_DEPTH + " SELECT id, depth FROM depth")
def q_category_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TX.depths(table(spark, sf_dir, "categories"))


@query(_DEPTH + _PRIORITY + " SELECT * FROM pr")
def q_auto_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TX.auto_priority(table(spark, sf_dir, "categories"))


@query(f"WITH {_CATS}{_THEMES} SELECT * FROM th")
def q_theme_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TX.auto_theme_order(table(spark, sf_dir, "categories"))


@query(_DEPTH + _TOP + _PRIORITY + _PICK + " SELECT id, site, category, top, steps AS depth FROM pick")
def q_category_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "categories")
    return TX.pick_category(TX.clean_posts(table(spark, sf_dir, "posts")), c, TX.auto_priority(c))


@query(_DEPTH + _TOP + _PRIORITY + _THEMES + _PICK + f""", r AS (SELECT pick.site, pick.id, p.url, p.date, pick.top, pick.category, pick.steps, coalesce(th.theme_no, pick.top) AS po, CASE WHEN steps = 0 THEN 1099511627776 ELSE category END AS so
  FROM pick JOIN {_POSTS} p ON p.id = pick.id JOIN c ON c.id = pick.category LEFT JOIN th ON th.id = pick.top WHERE steps = 0 OR c.parent = pick.top)
SELECT site, dense_rank() OVER (PARTITION BY site ORDER BY po, top) AS part_no, dense_rank() OVER (PARTITION BY site, top ORDER BY so) AS section_no, row_number() OVER (PARTITION BY site, top, so ORDER BY date, id) AS pos, url FROM r""")
def q_group_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TX.by_category(table(spark, sf_dir, "categories"), table(spark, sf_dir, "posts")).select("site", "part_no", "section_no", "pos", "url")


#: Slugs of parts and sections that come first, in this order.
_WANTED, _WANTED_SECTIONS = ["reviews", "projects"], ["archive", "notes", "projects"]


def _at(slugs: list[str], slug: str) -> str:
    return f"coalesce(list_position({slugs!r}, {slug}), 0)"


@query(_DEPTH + _TOP + _PRIORITY + _PICK + f""", r AS (SELECT pick.site, pick.id, p.url, p.date, pick.top, pick.category, tc.slug AS part_slug, steps,
    CASE WHEN {_at(_WANTED, "tc.slug")} > 0 THEN 0 ELSE 1 END AS pl, CASE WHEN {_at(_WANTED, "tc.slug")} > 0 THEN {_at(_WANTED, "tc.slug")} ELSE pick.top END AS po,
    CASE WHEN steps = 0 THEN 2 WHEN {_at(_WANTED_SECTIONS, "c.slug")} > 0 THEN 0 ELSE 1 END AS sl, CASE WHEN steps = 0 THEN 0 WHEN {_at(_WANTED_SECTIONS, "c.slug")} > 0 THEN {_at(_WANTED_SECTIONS, "c.slug")} ELSE category END AS so,
    CASE WHEN steps = 0 THEN 0 ELSE category END AS sc
  FROM pick JOIN {_POSTS} p ON p.id = pick.id JOIN c ON c.id = pick.category JOIN c tc ON tc.id = pick.top WHERE steps = 0 OR c.parent = pick.top)
SELECT site, dense_rank() OVER (PARTITION BY site ORDER BY pl, po, top) AS part_no, part_slug, dense_rank() OVER (PARTITION BY site, top ORDER BY sl, so, sc) AS section_no,
  row_number() OVER (PARTITION BY site, top, sl, so, sc ORDER BY date, id) AS pos, url FROM r""")
def q_theme_order_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category plan with explicit orders of parts and sections; what they don't name comes behind, by id."""
    plan = TX.by_category(table(spark, sf_dir, "categories"), table(spark, sf_dir, "posts"), theme_order=_WANTED, section_order=_WANTED_SECTIONS)
    return plan.select("site", "part_no", "part_slug", "section_no", "pos", "url")


def _category_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(TX.by_category(table(spark, sf_dir, "categories"), table(spark, sf_dir, "posts")), "plan")


@query(_DEPTH + _TOP + _PRIORITY + _THEMES + _PICK + f""", r AS (SELECT pick.site, pick.id, p.url, p.date, pick.top, pick.category, pick.steps, coalesce(th.theme_no, pick.top) AS po, CASE WHEN steps = 0 THEN 1099511627776 ELSE category END AS so, tc.slug AS part_slug, CASE WHEN steps = 0 THEN '__self__' ELSE c.slug END AS section_slug
  FROM pick JOIN {_POSTS} p ON p.id = pick.id JOIN c ON c.id = pick.category JOIN c tc ON tc.id = pick.top LEFT JOIN th ON th.id = pick.top WHERE steps = 0 OR c.parent = pick.top),
plan AS (SELECT dense_rank() OVER (PARTITION BY site ORDER BY po, top) AS part_no, part_slug, dense_rank() OVER (PARTITION BY site, top ORDER BY so) AS section_no, section_slug, row_number() OVER (PARTITION BY site, top, so ORDER BY date, id) AS pos, url FROM r)
SELECT * FROM plan UNION ALL SELECT (SELECT max(part_no) + 1 FROM plan), '{G.ORPHAN_SLUG}', 1, '{G.ORPHAN_SLUG}', row_number() OVER (ORDER BY seq, url), url FROM {_ENTRIES} WHERE url NOT IN (SELECT url FROM plan)""")
def q_plan_with_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category plan of all sites with a last part of posts it has no place for."""
    plan = _category_plan(spark, sf_dir).drop("site")
    return G.rescue_orphans(plan, _entries(spark, sf_dir).select("url", "seq")).select("part_no", "part_slug", "section_no", "section_slug", "pos", "url")


_A = "(SELECT article_no, min(id) AS id, min(title) AS title, min(source_url) AS url, min(published_at) AS date, min(word_count) AS words, min(idx) AS idx, min(file) AS file FROM articles GROUP BY article_no)"
_AYEAR = "regexp_extract(" + _strip("coalesce(date, '')") + r", '^(\d{4})', 1)"
_APLAN = f"""e AS (SELECT *, CASE WHEN {_AYEAR} <> '' THEN {_AYEAR} ELSE '未标日期' END AS t FROM {_A}),
p AS (SELECT t, row_number() OVER (ORDER BY CASE WHEN t = '未标日期' THEN '~' ELSE t END) AS part_no FROM (SELECT DISTINCT t FROM e)),
plan AS (SELECT part_no, t AS part_title, 1 AS section_no, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN t = '未标日期' THEN '' ELSE coalesce(date, '') END, CASE WHEN t = '未标日期' THEN '' ELSE url END, article_no) AS pos, url, article_no, words, title, idx FROM e JOIN p USING (t))"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(table(spark, sf_dir, "articles"))


def _article_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir).select(F.col("source_url").alias("url"), "title", F.col("published_at").alias("date"), F.col("article_no").alias("seq"))
    return written(G.by_date(a), "plan")


@query(f"WITH {_APLAN}, w AS (SELECT split_part(url, '#', 1) AS k, max(coalesce(words, 0)) AS words FROM e GROUP BY 1) SELECT part_no, section_no, count(*) AS n_articles, CAST(sum(coalesce(w.words, 0)) AS BIGINT) AS words FROM plan LEFT JOIN w ON w.k = split_part(plan.url, '#', 1) GROUP BY ROLLUP (part_no, section_no)")
def q_part_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _articles(spark, sf_dir).select(F.col("source_url").alias("url"), F.coalesce("word_count", F.lit(0)).alias("words"))
    return G.rollup(_article_plan(spark, sf_dir), words).select("part_no", "section_no", "n_articles", F.col("words").cast("long").alias("words"))


@query(f"WITH {_APLAN} SELECT part_no, section_no, pos, url FROM plan ORDER BY pos, part_no, section_no LIMIT 100")
def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling feature: 100 articles, in turn from all parts."""
    return G.round_robin(_article_plan(spark, sf_dir), 100).select("part_no", "section_no", "pos", "url")


@query(f"WITH {_APLAN} SELECT part_no, CAST(0 AS BIGINT) AS section_no, part_title || '  (' || count(*) || ' 篇)' AS line FROM plan GROUP BY part_no, part_title")
def q_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary_lines(_article_plan(spark, sf_dir))


@query(f"WITH {_APLAN}, x AS (SELECT DISTINCT url FROM extracts) SELECT article_no, coalesce(part_title, '') AS part_title FROM (SELECT e.article_no, last(l.part_title ORDER BY part_no, section_no, pos) AS part_title FROM e LEFT JOIN plan l ON split_part(l.url, '#', 1) = split_part(e.url, '#', 1) GROUP BY 1)")
def q_attach_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir).select("article_no", F.col("source_url").alias("url"))
    return G.attach(a, _article_plan(spark, sf_dir)).select("article_no", "part_title")


_KEYS = "(SELECT DISTINCT split_part(url, '#', 1) AS k FROM extracts)"


@query(f"SELECT article_no FROM {_A} WHERE split_part(url, '#', 1) NOT IN (SELECT k FROM {_KEYS})")
def q_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without an extract yet."""
    a = _articles(spark, sf_dir).select("article_no", F.col("source_url").alias("url"))
    return A.todo(a, table(spark, sf_dir, "extracts"), known_url="url").select("article_no")


@query(f"WITH {_APLAN} SELECT part_no, pos, url FROM plan WHERE split_part(url, '#', 1) IN (SELECT k FROM {_KEYS})")
def q_kept_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kept(_article_plan(spark, sf_dir), table(spark, sf_dir, "extracts").select("url")).select("part_no", "pos", "url")


_DOUBLE = f"WITH {_APLAN}, d AS (SELECT part_no, section_no, pos, url FROM plan UNION ALL SELECT part_no + 100, section_no, pos, url FROM plan), x AS (SELECT DISTINCT extract_id, url FROM extracts)"


def _double_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _article_plan(spark, sf_dir)
    return p.unionByName(p.withColumn("part_no", F.col("part_no") + 100))


@query(_DOUBLE + ", f AS (SELECT split_part(url, '#', 1) AS k, part_no, pos, row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY part_no, section_no, pos) AS r FROM d) SELECT part_no, pos, extract_id FROM f JOIN x ON split_part(x.url, '#', 1) = f.k WHERE r = 1")
def q_place_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts at their first place in a plan that names every address twice."""
    x = table(spark, sf_dir, "extracts").select("extract_id", "url").distinct()
    return G.place_once(_double_plan(spark, sf_dir), x).select("part_no", "pos", "extract_id")


@query("SELECT DISTINCT fetch_id FROM fetches WHERE split_part(url, '#', 1) NOT IN (SELECT split_part(source_url, '#', 1) FROM articles)")
def q_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages outside of the plan."""
    f = table(spark, sf_dir, "fetches").select("fetch_id", "url").distinct()
    return G.leftovers(_article_plan(spark, sf_dir), f).select("fetch_id")


@query(f"WITH {_APLAN} SELECT url, article_no FROM plan WHERE url NOT IN (SELECT url FROM extracts)")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article addresses, as written, that no extract has."""
    x = table(spark, sf_dir, "extracts").select("url")
    a = _articles(spark, sf_dir).select(F.col("source_url").alias("url"), F.col("article_no").alias("seq"))
    return G.orphans(x, a).select("url", F.col("seq").alias("article_no"))


@query(f"WITH {_APLAN}, x AS (SELECT article_no, url, title FROM e) SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'chapter' AS kind, count(*) AS n FROM (SELECT DISTINCT url FROM plan) UNION ALL SELECT 'part', count(DISTINCT part_no) FROM plan)")
def q_spine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the book in reading order, by kind."""
    ch = _articles(spark, sf_dir).select(F.col("source_url").alias("url"), "title")
    return toc.spine(_article_plan(spark, sf_dir), ch).groupBy("kind").agg(F.count("*").alias("n"))


_LINE = "lpad(idx::VARCHAR, greatest(3, length(idx::VARCHAR))::INTEGER, ' ') || '. [' || coalesce(title, '') || '](' || coalesce(file, '') || ')' || CASE WHEN coalesce(date, '') <> '' AND coalesce(words, 0) > 0 THEN ' —— ' || date || ' · ' || format('{:,}', words) || ' 字' WHEN coalesce(date, '') <> '' THEN ' —— ' || date WHEN coalesce(words, 0) > 0 THEN ' —— ' || format('{:,}', words) || ' 字' ELSE '' END"


@query(f"SELECT article_no, {_LINE} AS line FROM {_A}")
def q_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return a.select("article_no", toc.index_line(F.col("idx"), F.col("title"), F.col("file"), F.col("published_at"), F.col("word_count")).alias("line"))


@query(f"""WITH {_APLAN}, f AS (SELECT k, part_no FROM (SELECT split_part(url, '#', 1) AS k, part_no, row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY part_no, pos) AS n FROM plan) WHERE n = 1)
SELECT part_no, CAST(0 AS BIGINT) AS section_no, 0 AS idx, '### ' || part_title || '（' || count(*) || ' 篇）' AS line FROM plan GROUP BY part_no, part_title
UNION ALL SELECT f.part_no, CAST(1 AS BIGINT), idx, {_LINE} FROM {_A} a JOIN f ON f.k = split_part(a.url, '#', 1)""")
def q_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index: headings and lines."""
    return toc.index_lines(_article_plan(spark, sf_dir), _articles(spark, sf_dir))


# -- the archive's articles

@query(f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY article_no) AS n FROM {_A}) SELECT article_no, CASE WHEN n > 1 THEN title || '（' || n || '）' ELSE title END AS shown FROM a")
def q_title_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.title_suffixes(_articles(spark, sf_dir), seq="article_no").select("article_no", "shown")


@query(f"SELECT article_no, 1000 + row_number() OVER (ORDER BY article_no) AS number FROM {_A}")
def q_number_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.number(_articles(spark, sf_dir), ["article_no"], 1000, "number").select("article_no", "number")


def _order_sql(keys: str) -> str:
    return f"SELECT article_no, row_number() OVER (ORDER BY {keys}) AS pos FROM {_A}"


def _ordered(order: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.ordered(_articles(spark, sf_dir), order, "article_no").select("article_no", "pos")

    return run


for _name, _sql in {
    "site": "article_no", "reverse": "article_no DESC", "date-asc": "CASE WHEN coalesce(date, '') = '' THEN '9999' ELSE date END, article_no",
    "date-desc": "CASE WHEN coalesce(date, '') = '' THEN '0000' ELSE date END DESC, article_no",
}.items():
    QUERIES[f"q_sort_{_name.replace('-', '_')}"] = _ordered(_name)
    ORACLE[f"q_sort_{_name.replace('-', '_')}"] = _order_sql(_sql)
QUERIES["q_sort_alpha"] = _ordered("alpha")
ORACLE["q_sort_alpha"] = _order_sql("lower(title), article_no")


@query("""WITH a AS (SELECT article_no, idx, coalesce(date, '') AS d FROM """ + _A + r"""), b AS (SELECT *, regexp_extract(d, '^\s*(\d+)\s*(?:-|$)', 1) AS y, regexp_extract(d, '^\s*\d+\s*-\s*(\d+)\s*(?:-|$)', 1) AS m FROM a)
SELECT article_no, row_number() OVER (ORDER BY CASE WHEN d = '' THEN 1 ELSE 0 END, CASE WHEN y <> '' AND (m <> '' OR NOT contains(d, '-')) THEN y::BIGINT * 100 + coalesce(nullif(m, ''), '0')::BIGINT ELSE 0 END DESC, article_no) AS pos FROM b""")
def q_reorder_date_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir).withColumn("idx", F.col("article_no"))
    return A.reordered(a, "date-desc").select("article_no", "pos")


_TAILS = """WITH t AS (SELECT extract_id, """ + _site("url") + """ AS site, """ + _strip("coalesce(title, '')") + """ AS t FROM (SELECT DISTINCT extract_id, url, title FROM extracts)),
s AS (SELECT *, CASE WHEN contains(t, ' - ') THEN split_part(t, ' - ', -1) WHEN contains(t, ' – ') THEN split_part(t, ' – ', -1) WHEN contains(t, ' — ') THEN split_part(t, ' — ', -1) WHEN contains(t, ' | ') THEN split_part(t, ' | ', -1) WHEN contains(t, ' · ') THEN split_part(t, ' · ', -1) END AS tail0 FROM t),
u AS (SELECT site, """ + _strip("tail0") + """ AS tail, count(*) AS n, min(extract_id) AS f FROM s WHERE tail0 IS NOT NULL AND length(t) >= 4 GROUP BY 1, 2 HAVING length(tail) BETWEEN 2 AND 30),
b AS (SELECT site, tail, n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, f) AS k FROM u) WHERE k = 1)
SELECT site, tail, n FROM b JOIN (SELECT site, count(*) AS total FROM t GROUP BY 1) USING (site) WHERE n >= 3 AND n >= total * 0.15"""


@query(_TAILS)
def q_common_title_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracts").select("extract_id", "title", U.site(F.col("url")).alias("site")).distinct()
    return TT.common_tail(e, "title", ["site"], "extract_id", min_share=0.15)


@query("WITH t AS (SELECT DISTINCT extract_id, " + _site("url") + " AS site, " + _strip("coalesce(title, '')") + " AS t FROM extracts), x AS (SELECT *, ' - ' || site AS a, ' – ' || site AS b, ' | ' || site AS c FROM t) SELECT extract_id, CASE WHEN site <> '' AND ends_with(t, a) THEN trim(substring(t, 1, length(t) - length(a))) WHEN site <> '' AND ends_with(t, b) THEN trim(substring(t, 1, length(t) - length(b))) WHEN site <> '' AND ends_with(t, c) THEN trim(substring(t, 1, length(t) - length(c))) ELSE t END AS title FROM x")
def q_strip_site_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracts").select("extract_id", "title", U.site(F.col("url")).alias("site")).distinct()
    return e.select("extract_id", TT.strip_site_suffix(F.col("title"), F.col("site")).alias("title"))


@query("SELECT doc_id, first(doc_id) OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS stored FROM documents WHERE text IS NOT NULL")
def q_content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return A.dedupe_by_content(d, "text", "doc_id", "doc_id").select("doc_id", "stored")


@query(f"SELECT id, CASE WHEN article_no % 3 = 0 THEN title || '*' ELSE title END AS title FROM {_A}")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third article's title replaced by id."""
    a = _articles(spark, sf_dir).select("id", "title", "article_no")
    return A.upsert(a, a.where("article_no % 3 = 0").withColumn("title", F.concat("title", F.lit("*")))).select("id", "title")


@query("""WITH RECURSIVE s AS (SELECT id, slug, row_number() OVER (ORDER BY id) AS n FROM (SELECT id, min(slug) AS slug FROM categories WHERE coalesce(slug, '') <> '' GROUP BY id)),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS id, '' AS name, CAST([] AS VARCHAR[]) AS taken UNION ALL
  SELECT t.n, t.id, t.name, list_append(t.taken, t.name) FROM (SELECT s.n, s.id, w.taken, CASE WHEN NOT list_contains(w.taken, s.slug) THEN s.slug
    ELSE s.slug || '-' || list_filter(range(2, s.n + 3), lambda k: NOT list_contains(w.taken, s.slug || '-' || k))[1] END AS name FROM w JOIN s ON s.n = w.n + 1) t)
SELECT id, name FROM w WHERE n > 0""")
def q_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category's slug, or the first of slug-2, slug-3, ... that no category before it has taken."""
    c = table(spark, sf_dir, "categories").where("slug <> ''").groupBy("id").agg(F.min("slug").alias("slug"))
    return A.unique_slugs(c, "slug", "id", "name").select("id", "name")


@query()
def q_unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for every article from its title, none twice."""
    a = _articles(spark, sf_dir).select("article_no", A.slugs_of(F.col("title"), F.col("source_url")).alias("slug"))
    return A.unique_slugs(a, "slug", "article_no").select("article_no", "id")


@query("SELECT coalesce(lang, '') AS lang, count(*) AS n, min(extract_id) AS first FROM (SELECT DISTINCT extract_id, lang FROM extracts) GROUP BY 1")
def q_language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracts").select("extract_id", T.or_empty(F.col("lang")).alias("lang")).distinct()
    return A.histogram(e, "lang", "extract_id")


@query("SELECT strategy, count(*) AS n, min(extract_id) AS first FROM (SELECT DISTINCT extract_id, strategy FROM extracts) GROUP BY 1")
def q_strategy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "extracts").select("extract_id", "strategy").distinct(), "strategy", "extract_id")


_BEST = "(SELECT article_no, arg_max(fetch_status, CASE fetch_status WHEN 'ok' THEN 3 WHEN 'partial' THEN 2 WHEN 'skipped' THEN 1 ELSE 0 END) AS fetch_status FROM articles GROUP BY 1)"


@query(f"""SELECT CAST(fetched AS BIGINT) AS fetched, failed, ok, extracted, CAST(words AS BIGINT) AS words_total, CAST(images AS BIGINT) AS images_localized, low AS low_confidence FROM
 (SELECT count(*) AS fetched, count_if(fetch_status = 'failed') AS failed, count_if(fetch_status <> 'failed') AS ok FROM {_BEST}),
 (SELECT count(*) AS extracted, sum({_words('markdown')}) AS words, sum(coalesce(len(images), 0)) AS images, count_if(coalesce(confidence, 0) < 0.6) AS low FROM (SELECT DISTINCT extract_id, markdown, images, confidence FROM extracts))""")
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracts").select("extract_id", "markdown", "images", "confidence").distinct().withColumn("word_count", T.count_words(F.col("markdown")))
    return A.quality_report(e, _articles(spark, sf_dir)).select("fetched", "failed", "ok", "extracted", F.col("words_total").cast("long"), F.col("images_localized").cast("long"), "low_confidence")


@query(f"SELECT count_if(fetch_status = 'failed') AS errors, count_if(fetch_status = 'partial') + (SELECT count(*) FROM (SELECT article_no, unnest(assets) AS p FROM (SELECT article_no, min(assets) AS assets FROM articles GROUP BY 1))) AS warnings FROM {_BEST}")
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit against a store with all texts and no assets."""
    a = _articles(spark, sf_dir)
    files = a.select("file", F.lit("text").alias("body"))
    return A.audit_levels(A.audit(a, files, spark.createDataFrame([], "path string")))


@query("SELECT CASE WHEN lower(coalesce(error, '')) LIKE '%robots%' THEN 'robots' WHEN coalesce(status, 0) > 0 THEN 'http-' || status ELSE 'network' END AS reason, count(*) AS n FROM (SELECT DISTINCT fetch_id, error, status FROM fetches WHERE NOT ok) GROUP BY 1")
def q_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.failure_reasons(table(spark, sf_dir, "fetches").select("fetch_id", "ok", "status", "error").distinct())


@query(f"SELECT DISTINCT {_site('source_url')} AS host FROM articles ORDER BY 1 LIMIT 8")
def q_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first eight hosts."""
    return A.sources(table(spark, sf_dir, "articles"))


@query("SELECT DISTINCT fetch_id, CASE WHEN NOT ok OR octet_length(coalesce(content, ''::BLOB)) = 0 THEN CASE WHEN lower(coalesce(error, '')) LIKE '%robots%' THEN 'robots' WHEN coalesce(status, 0) > 0 THEN 'http-' || status ELSE 'network' END WHEN octet_length(content) > 12582912 THEN 'too_big' WHEN octet_length(content) < 512 THEN 'too_small' END AS problem FROM fetches WHERE content_type LIKE 'image/%'")
def q_image_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fetches").where(F.col("content_type").like("image/%"))
    return f.select("fetch_id", FE.image_problem(F.col("ok"), F.col("status"), F.col("error"), F.col("content")).alias("problem")).distinct()


# -- adapters, extraction, chunks

def _adapters() -> list[AD.ConfigAdapter]:
    return [AD.ConfigAdapter.of(c) for c in ({"name": "posts", "match_regex": r"/post/\w"}, {"name": "lantern", "hosts": ["lanternpress.example"]}, {"name": "test", "hosts": ["test"]}, {"name": "secure", "url_prefixes": ["https://"]})]


@query("""SELECT DISTINCT article_no, CASE WHEN regexp_matches(source_url, '/post/\\w') THEN 'posts' WHEN h = 'lanternpress.example' OR h LIKE '%.lanternpress.example' THEN 'lantern' WHEN h = 'test' OR h LIKE '%.test' THEN 'test' WHEN starts_with(source_url, 'https://') THEN 'secure' END AS adapter
 FROM (SELECT article_no, source_url, lower(regexp_extract(source_url, '://([^/?#]*)', 1)) AS h FROM articles)""")
def q_adapter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four adapters that matches each article's address."""
    a = _articles(spark, sf_dir).select("article_no", F.col("source_url").alias("url"))
    return AD.match_urls(a, AD.adapter_rows(spark, _adapters())).select("article_no", "adapter")


@query()
def q_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, Markdown, confidence and the rest of every fetched page."""
    f = table(spark, sf_dir, "fetches").where("ok").select("fetch_id", "url", F.col("text").alias("html")).distinct()
    return X.extract(f).drop("html")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracts").select("extract_id", "markdown", "title", "summary").distinct()
    return written(C.prepare(e, "extract_id", "markdown"), "chunks")


@query()
def q_prepare_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation chunks of every extract."""
    return _chunks(spark, sf_dir).drop("first", "vault")


@query()
def q_translate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extract put together from chunks, a third of them without translation."""
    c = _chunks(spark, sf_dir)
    tr = C.translate(c, str.upper).where(F.pmod(F.xxhash64("id"), F.lit(3)) > 0)
    return C.apply(c, tr).select("article", "body", "chunks", "translated", F.size("problems").alias("n_problems"))


@query("SELECT id, CASE WHEN length(s) < 2 OR regexp_matches(s, '^[\\d\\-/:.\\s]+$') OR regexp_matches(s, '^https?://') THEN false ELSE true END AS worth FROM (SELECT DISTINCT id, " + _strip("coalesce(date_str, '')") + " AS s FROM posts)")
def q_translatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "posts").select("id", C.is_translatable(F.col("date_str")).alias("worth")).distinct()


@query("SELECT id, to_json(list_sort(list_distinct(regexp_extract_all(text, '⟦(\\d+)⟧', 1)))) AS marks, CAST(len(list_filter(regexp_split_to_array(" + _strip("text") + ", '\\n\\s*\\n'), lambda x: " + _strip("x") + " <> '')) AS INTEGER) AS n_blocks FROM (SELECT DISTINCT id, coalesce(text, '') AS text FROM chunks)")
def q_chunk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected marks and blocks of every chunk."""
    c = table(spark, sf_dir, "chunks").select("id", T.or_empty(F.col("text")).alias("text")).distinct()
    return c.select("id", F.to_json(F.array_sort(C.marks_in(F.col("text")))).alias("marks"), C.n_blocks(F.col("text")).alias("n_blocks"))


@query("SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) / count(*) AS avg_chars FROM (SELECT DISTINCT id, text FROM chunks)")
def q_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").select("id", "text").distinct().withColumn("chars", F.length("text"))
    return C.totals(c)


@query()
def q_check_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong if every chunk's translation is the next one of its article."""
    c = table(spark, sf_dir, "chunks").select("article", "idx", "text").distinct()
    j = c.alias("a").join(c.select("article", (F.col("idx") - 1).alias("idx"), F.col("text").alias("dst")), ["article", "idx"])
    return C.check(j.withColumnRenamed("text", "src")).select("article", "idx", F.array_join("issues", "; ").alias("issues"))


# -- books and logs

@query()
def q_typeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XHTML page of every extract."""
    e = table(spark, sf_dir, "extracts").select("extract_id", "title", "markdown").distinct()
    return e.select("extract_id", typeset.chapters(F.col("title"), F.col("markdown")).alias("xhtml"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'essay|文章|随笔|选集|collection|选读') THEN 'editorial' WHEN regexp_matches(t, 'handbook|guide|手册|指南|教程|notes') THEN 'band' WHEN regexp_matches(t, 'poem|诗|meditation|禅|静') THEN 'minimal' WHEN n_chars > 120000 THEN 'classic' ELSE 'classic' END AS style,
  list_sum(list_transform(range(1, length(t0) + 1), lambda i: CAST(unicode(substring(t0, i, 1)) AS BIGINT) * (i + 6))) AS seed FROM (SELECT doc_id, n_chars, coalesce(title, '') AS t0, lower(coalesce(title, '') || '  ') AS t FROM documents) WHERE t0 <> ''""")
def q_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover style and the seed of its palette for every titled document."""
    d = table(spark, sf_dir, "documents").where(T.or_empty(F.col("title")) != "")
    none = F.lit("")
    return d.select("doc_id", cover.recommend_style(F.col("title"), none, none, F.lit(1), F.col("n_chars")).alias("style"), cover.palette_seed(F.col("title")).alias("seed"))


@query("SELECT strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H') AS hour, count(*) AS pages, count_if(NOT ok) AS failed FROM fetches WHERE fetched_at IS NOT NULL GROUP BY 1")
def q_fetches_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.hourly(table(spark, sf_dir, "fetches")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))
