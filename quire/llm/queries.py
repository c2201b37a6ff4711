"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import boilerplate, encoding, lookalike, mixing, packing, sitelines, spampages, splitting
from quire.llm.tokens import VOCABULARY, n_tokens
from quire.session import spread, table, written


def _clean_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, t): text known to be read well."""
    return spread(table(spark, sf_dir, "extracts").select("extract_id", F.concat_ws("\n", "title", "markdown").alias("t")))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, piece_no, n_pieces, start, text, chars) of every chunk under its profile's limits."""
    return splitting.split_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_profiles"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) of the chunks that had to be split."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 1").select("id").distinct()


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, site, key, text, form) of article titles (site '') and category names."""
    a = table(spark, sf_dir, "articles").selectExpr("'articles.title' AS field", "'' AS site", "article_no AS key", "title AS text")
    c = table(spark, sf_dir, "categories").selectExpr("'categories.name' AS field", "site", "CAST(id AS BIGINT) AS key", "name AS text")
    rows = a.unionByName(c)
    return lookalike.add_form(rows, lookalike.fit(rows, "text"), "text", "form")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, key_a, key_b): titles, or names within a site, that differ but look the same."""
    return lookalike.equal_looking(p3_forms(spark, sf_dir), ["field", "site"]).select("field", "key_a", "key_b")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, site, form, spelling, class_key, spelling_key, key): membership in the looks with several spellings; pairs between classes' spellings follow from it."""
    return lookalike.members(p3_forms(spark, sf_dir), ["field", "site"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id) of the fetches whose text is garbled by a wrong encoding."""
    model = encoding.fit(_clean_extracts(spark, sf_dir), "extract_id", "t")
    rows = spread(table(spark, sf_dir, "fetches").select("fetch_id", "text", "content", "content_type"))
    return encoding.find_garbled(rows, model, content="content", content_type="content_type").select("fetch_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fetch once with its restored text and the encoding pairs that were undone."""
    model = encoding.fit(_clean_extracts(spark, sf_dir), "extract_id", "t")
    rows = spread(table(spark, sf_dir, "fetches").select("fetch_id", "content", "content_type", "text"))
    return encoding.repair(rows, model, content_type="content_type").select("fetch_id", "restored", F.concat_ws(" ", "pairs").alias("pairs")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, line_no) of lines repeated across a site. An extract's url is its article's source_url."""
    return sitelines.repeated_lines(spread(table(spark, sf_dir, "extracts").select("extract_id", "article_no", "url", "title", "markdown")))


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, cleaned): every extract's Markdown without the repeated lines."""
    ex = table(spark, sf_dir, "extracts").select("extract_id", "markdown").distinct()
    return sitelines.remove_lines(ex, p5_found(spark, sf_dir)).select("extract_id", "cleaned")


SMALL_SITE = 8


def _small_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, url, text) of the extracts of sites with fewer than SMALL_SITE articles."""
    art = table(spark, sf_dir, "articles").select(sitelines.site_of(F.col("source_url")).alias("site"), "article_no")
    few = art.where("site IS NOT NULL").distinct().groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") < SMALL_SITE).select("site")
    ex = table(spark, sf_dir, "extracts").select(F.col("extract_id").alias("key"), "url", F.col("markdown").alias("text"))
    return ex.withColumn("site", sitelines.site_of(F.col("url"))).join(few, "site", "left_semi").drop("site")


def _labelled(spark: SparkSession, sf_dir: str, ex: DataFrame) -> DataFrame:
    """(extract_id, line_no, content, on_page) of the extracts `ex` (key, url, text)."""
    pages = table(spark, sf_dir, "fetches").where("ok").select("url", F.col("text").alias("html"), F.col("fetched_at").alias("at"))
    chars = encoding.fit(_clean_extracts(spark, sf_dir), "extract_id", "t")
    all_ex = table(spark, sf_dir, "extracts").select("url", F.col("markdown").alias("text"))
    model, page_lines = boilerplate.train(pages, all_ex, chars)
    return boilerplate.label_lines_on(ex, page_lines, model).withColumnRenamed("key", "extract_id")


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, line_no, content, on_page): every non-blank line of small sites' extracts with P(content)."""
    return _labelled(spark, sf_dir, _small_extracts(spark, sf_dir))


def p6_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, line_no, content, on_page): every non-blank line of all extracts with P(content)."""
    ex = table(spark, sf_dir, "extracts").select(F.col("extract_id").alias("key"), "url", F.col("markdown").alias("text"))
    return _labelled(spark, sf_dir, spread(ex))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, line_no) of the lines of small sites' extracts that are page furniture."""
    return p6_lines(spark, sf_dir).where("content < 0.5").select("extract_id", "line_no").distinct()


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, cleaned): small sites' extracts with only the article's own lines."""
    ex = _small_extracts(spark, sf_dir).select(F.col("key").alias("extract_id"), F.col("text").alias("markdown")).distinct()
    return sitelines.remove_lines(ex, p6_found(spark, sf_dir)).select("extract_id", "cleaned")


def _sizes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, more..., tokens), tokens counted once and written."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"))
    return written(docs.select("doc_id", *more, n_tokens(F.col("text"), VOCABULARY).alias("tokens")).distinct(), "sizes")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile, container, doc_id, piece_no, start, size): every document in every profile's containers."""
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_profiles"), "doc_id", "tokens")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile, containers, used, unused_share)."""
    return packing.report(p7_pack(spark, sf_dir), table(spark, sf_dir, "pack_profiles"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, copies): the mixture at the targets' shares, as large as the repeats allow."""
    return mixing.mix(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, available, used, actual_share, times)."""
    return mixing.mix(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents that are keyword-stuffed or link lists."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spampages.page_shares(docs, spampages.fit(docs)).where("spam").select("doc_id").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of prose, link lists, tag lists and menus in every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spampages.page_shares(docs, spampages.fit(docs)).drop("text")


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, length, reached, too_long, gaps, altered): whether the pieces of a chunk hold all of it, in order, under the limit."""
    chunks, profiles = table(spark, sf_dir, "chunks").select("id", "text", "profile").distinct(), table(spark, sf_dir, "chunk_profiles")
    p = p1_pieces(spark, sf_dir).alias("p").join(chunks.join(profiles.select("profile", "max_chars"), "profile").alias("c"), "id")
    at = W.partitionBy("id").orderBy("piece_no")  # the pieces of one text
    p = p.select("id", "piece_no", "start", "chars", "max_chars", F.length("c.text").alias("n"), (F.col("p.text") != F.expr("substring(c.text, start + 1, chars)")).alias("altered"))
    p = p.withColumn("gap", F.col("start") > F.coalesce(F.lag(F.col("start") + F.col("chars")).over(at), F.lit(0)))
    return p.groupBy("id").agg(F.max("n").alias("length"), F.max(F.col("start") + F.col("chars")).alias("reached"), F.count_if(F.col("chars") > F.col("max_chars")).alias("too_long"), F.count_if("gap").alias("gaps"), F.count_if("altered").alias("altered"))


def _n_lines(c: str) -> F.Column:
    return F.size(F.split(F.coalesce(c, F.lit("")), "\n"))


def p5_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, lines): lines of the cleaned text and lines removed, together."""
    found = p5_found(spark, sf_dir).groupBy("extract_id").agg(F.count("*").alias("gone"))
    ex = table(spark, sf_dir, "extracts").select("extract_id", "markdown").distinct()
    cleaned = sitelines.remove_lines(ex, p5_found(spark, sf_dir))
    left = F.when((F.col("cleaned") == "") & (F.coalesce("gone", F.lit(0)) == _n_lines("markdown")), 0).otherwise(_n_lines("cleaned"))
    return cleaned.join(found, "extract_id", "left").select("extract_id", (left + F.coalesce("gone", F.lit(0))).alias("lines"))


def p6_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, lines): lines of small sites' extracts that have a marginal."""
    return p6_lines(spark, sf_dir).select("extract_id", "line_no").distinct().groupBy("extract_id").agg(F.count("*").alias("lines"))


def p7_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile, documents, over, split, partial): documents packed, containers over their capacity, documents split though they fit, documents not wholly packed."""
    sizes = _sizes(spark, sf_dir)
    packed = written(packing.pack(sizes, table(spark, sf_dir, "pack_profiles"), "doc_id", "tokens"), "packed")
    cap = table(spark, sf_dir, "pack_profiles").select("profile", "capacity_tokens").distinct()
    over = packed.groupBy("profile", "container").agg(F.sum("size").alias("used")).join(cap, "profile").groupBy("profile").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over"))
    docs = packed.groupBy("profile", "doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size")).join(sizes, "doc_id").join(cap, "profile")
    split, partial = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens")), F.col("size") != F.col("tokens")
    return docs.groupBy("profile").agg(F.count("*").alias("documents"), F.count_if(split).alias("split"), F.count_if(partial).alias("partial")).join(over, "profile")


def p8_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, too_often, off): whether a source is used more than it may, or its share is off by more than a document of each source explains."""
    targets = table(spark, sf_dir, "mix_targets")
    sizes = _sizes(spark, sf_dir, "source")
    chosen, shares = mixing.mix(sizes, targets)
    chosen = written(chosen, "mixed")
    largest = sizes.groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.max("tokens").alias("largest")).join(targets.select(mixing.source_name(F.col("source")).alias("source")), "source", "left_semi")
    whole = chosen.agg(F.sum(F.col("tokens") * F.col("copies")).alias("whole")).crossJoin(F.broadcast(largest.agg(F.sum("largest").alias("slack"))))
    wanted = targets.select(mixing.source_name(F.col("source")).alias("source"), "max_repeats")
    # sources without documents leave their share to the others
    live = shares.where("available > 0").agg(F.sum("target_share").alias("live"))
    j = shares.join(largest, "source", "left").join(wanted, "source").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(live))
    share = F.when(F.col("available") > 0, F.col("target_share") / F.col("live")).otherwise(0)
    off = F.abs(F.col("used") - share * F.col("whole")) > F.coalesce("largest", F.lit(0)) + share * F.col("slack") + 1
    return j.select("source", "target_share", (F.col("times") > F.col("max_repeats")).alias("too_often"), off.alias("off"))


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, whole): the sum of a document's shares, 0 where there is nothing to read."""
    s = p9_shares(spark, sf_dir)
    return s.select("doc_id", F.round(F.col("prose") + F.col("links") + F.col("tags") + F.col("menu"), 6).alias("whole"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_cover": p1_cover, "p3_found": p3_found, "p3_forms": p3_forms, "p3_members": p3_members, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_cleaned": p5_cleaned, "p5_left": p5_left, "p6_found": p6_found, "p6_lines": p6_lines, "p6_all_lines": p6_all_lines, "p6_cleaned": p6_cleaned, "p6_covered": p6_covered, "p7_pack": p7_pack, "p7_report": p7_report, "p7_held": p7_held, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_held": p8_held, "p9_found": p9_found, "p9_shares": p9_shares, "p9_whole": p9_whole}

# SQL of p5: letters of a text, a site, the letters a title slot may hold, and the templates of a line
_SITE = "nullif(regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '')"


def _letters(x: str) -> str:
    return rf"lower(regexp_replace(nfc_normalize({x}), '[^\p{{L}}\p{{Nl}}\p{{No}}\x{{E001}}]', '', 'g'))"


_P5 = rf"""WITH x AS (SELECT DISTINCT extract_id, article_no, url, coalesce(title, '') AS title, markdown, {_SITE.format("url")} AS site FROM extracts WHERE url IS NOT NULL AND markdown IS NOT NULL AND article_no IS NOT NULL AND extract_id IS NOT NULL),
e AS (SELECT * FROM x WHERE site IS NOT NULL),
cut AS (SELECT DISTINCT title, site, unnest(range(1, length(title) + 1)) AS i FROM e),
titles AS (SELECT DISTINCT title, site, t FROM (
  SELECT title, site, {_letters("title")} AS t FROM e UNION ALL
  SELECT title, site, {_letters("substring(title, 1, i - 1)")} FROM (SELECT *, regexp_extract(substring(title, i), '^\s+[-–—|·»:/]\s+') AS sep FROM cut WHERE i = 1 OR NOT regexp_matches(substring(title, i - 1, 1), '\s'))
    WHERE sep <> '' AND ({_letters("substring(title, i + length(sep))")} = {_letters("site")} OR length({_letters("substring(title, i + length(sep))")}) > 4 AND contains({_letters("site")}, {_letters("substring(title, i + length(sep))")}))) WHERE t <> ''),
own AS (SELECT title, site, list(t ORDER BY length(t), t) AS ts FROM titles GROUP BY 1, 2),
l AS (SELECT extract_id, article_no, url, title, site, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS line_no FROM e),
p AS (SELECT *, contains(line, url) AS quoted, {_letters("regexp_replace(line, regexp_escape(url) || '(?:#[^\\s()\\[\\]<>" + chr(34) + "”»]*)?', chr(57345), 'g')")} AS plain FROM l),
s AS (SELECT *, CASE WHEN NOT quoted AND {_letters("url")} <> '' THEN replace(plain, {_letters("url")}, chr(57345)) ELSE plain END AS half FROM p WHERE plain <> ''),
h AS (SELECT s.*, list_filter(coalesce(ts, []), lambda t: contains(half, t))[1] AS hit FROM s LEFT JOIN own USING (title, site)),
t AS (SELECT extract_id, article_no, site, line_no, plain AS template FROM h UNION SELECT extract_id, article_no, site, line_no, CASE WHEN replace(plain, chr(57345), '') = '' OR hit IS NULL THEN half ELSE replace(half, hit, chr(57344)) END FROM h),
n AS (SELECT site, count(DISTINCT article_no) AS n FROM e GROUP BY 1),
bad AS (SELECT site, template FROM t JOIN n USING (site) GROUP BY site, template HAVING count(DISTINCT article_no) >= 8 AND count(DISTINCT article_no) >= 0.15 * any_value(n))
SELECT DISTINCT extract_id, CAST(line_no AS INTEGER) AS line_no FROM t JOIN bad USING (site, template)"""

_SMALL = rf"""SELECT {_SITE.format("source_url")} AS site FROM (SELECT DISTINCT article_no, source_url FROM articles) GROUP BY 1 HAVING site IS NOT NULL AND count(DISTINCT article_no) < 8"""

ORACLE: dict[str, str] = {
    "p1_found": "SELECT DISTINCT id FROM chunks JOIN chunk_profiles USING (profile) WHERE length(text) > max_chars",
    "p1_cover": "SELECT DISTINCT id, length(text) AS length, length(text) AS reached, 0 AS too_long, 0 AS gaps, 0 AS altered FROM chunks JOIN chunk_profiles USING (profile) WHERE text IS NOT NULL",
    "p5_found": _P5,
    "p5_left": "SELECT DISTINCT extract_id, len(string_split(coalesce(markdown, ''), chr(10))) AS lines FROM extracts",
    "p6_covered": rf"SELECT extract_id, count(*) AS lines FROM (SELECT extract_id, unnest(string_split(markdown, chr(10))) AS line FROM (SELECT DISTINCT extract_id, url, markdown FROM extracts) WHERE {_SITE.format('url')} IN ({_SMALL})) WHERE regexp_matches(line, '[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]') GROUP BY 1",
    "p7_held": "SELECT profile, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS over, 0 AS split, 0 AS partial FROM pack_profiles",
    "p8_held": "SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_\\-]+', '-', 'g') AS source, target_share, false AS too_often, false AS off FROM mix_targets",
    "p9_whole": r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS whole FROM documents",
}
