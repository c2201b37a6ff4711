"""Book plans: articles ordered into parts and sections.

A plan is a flat table: part_no, part_title, part_slug, section_no, section_title, section_slug,
pos, url. Parts, sections and positions count from 1. Entries are tables with url, title, date and
seq (their order of input); missing dates are ''. Repeated urls are repeated entries, as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import url as U
from quire.operators.ranking import row_numbers
from quire.session import small

# Names of the parts and sections that aren't the site's own.
UNDATED, UNDATED_SLUG = "未标日期", "undated"
ORPHANS, ORPHAN_SECTION, ORPHAN_SLUG = "未分类", "综合", "__orphan__"
SELF_SLUG, FLAT_SLUG = "__self__", "__flat__"
STRATEGIES = ("category", "date", "path", "flat")
PLAN = ["part_no", "part_title", "part_slug", "section_no", "section_title", "section_slug", "pos", "url"]
#: A plan of more parts than this isn't broadcast.
MAX_PARTS = 10_000
#: The most urls a part may have in nested form.
MAX_NESTED = 200_000
# Fixed value: the part of what a plan has no place for.
NO_RANK = 10**9
#: Urls in one line of a nested file.
PIECE = 10_000


def _date(c: str = "date") -> Column:
    return T.strip(T.or_empty(F.col(c)))


def _one_section(df: DataFrame, parts: DataFrame, slug: Column) -> DataFrame:
    """A plan of parts without sections from (part_title, pos, url) and the numbers of the parts."""
    return df.join(small(parts, MAX_PARTS), "part_title").select(
        F.col("part_no").cast("long").alias("part_no"), "part_title", slug.alias("part_slug"), F.lit(1).cast("long").alias("section_no"),
        F.lit("").alias("section_title"), F.lit("").alias("section_slug"), F.col("pos").cast("long").alias("pos"), "url",
    )


def by_date(entries: DataFrame) -> DataFrame:
    """Parts are years, oldest first, ordered by (date, url); then the undated in order of input."""
    year = F.regexp_extract(_date(), r"^(\d{4})", 1)
    e = entries.select("url", T.or_empty(F.col("date")).alias("date"), "seq", F.when(year != "", year).otherwise(UNDATED).alias("part_title"))
    undated = F.col("part_title") == UNDATED
    e = row_numbers(e, ["part_title"], [F.when(undated, "").otherwise(F.col("date")), F.when(undated, "").otherwise(F.col("url")), "seq"], "pos")
    parts = row_numbers(e.select("part_title").distinct(), [], [F.when(undated, "~").otherwise(F.col("part_title"))], "part_no")
    return _one_section(e, parts, F.when(undated, UNDATED_SLUG).otherwise(F.concat(F.lit("y"), F.col("part_title"))))


def by_path(entries: DataFrame) -> DataFrame:
    """Parts are first path segments, the fullest first, ordered by (date, url)."""
    e = entries.select("url", T.or_empty(F.col("date")).alias("date"), "seq", U.title_from_path(F.col("url")).alias("part_title"))
    e = row_numbers(e, ["part_title"], ["date", "url", "seq"], "pos")
    parts = row_numbers(e.groupBy("part_title").agg(F.count("*").alias("n")), [], [("n", "desc"), "part_title"], "part_no").drop("n")
    slugs = parts.select("part_title", "part_no", T.slugify(F.col("part_title"), 40).alias("part_slug"))
    return _one_section(e, slugs, F.col("part_slug"))


def by_flat(entries: DataFrame) -> DataFrame:
    """One unnamed part and section, ordered by (date, url)."""
    e = row_numbers(entries.select("url", T.or_empty(F.col("date")).alias("date"), "seq"), [], ["date", "url", "seq"], "pos")
    return e.select(
        F.lit(1).cast("long").alias("part_no"), F.lit("").alias("part_title"), F.lit(FLAT_SLUG).alias("part_slug"), F.lit(1).cast("long").alias("section_no"),
        F.lit("").alias("section_title"), F.lit(SELF_SLUG).alias("section_slug"), F.col("pos").cast("long").alias("pos"), "url",
    )


def choose_strategy(api_root: str | None, requested: str = "auto") -> str:
    """What is requested; for auto, category if the site has an interface for it, else date."""
    if requested and requested != "auto":
        return requested
    return "category" if api_root else "date"


def build_plan(entries: DataFrame | None, by: str = "auto", api_root: str | None = None, categories: DataFrame | None = None, posts: DataFrame | None = None) -> DataFrame:
    """The plan under a strategy; category without an interface falls back to date."""
    strategy = choose_strategy(api_root, by)
    if strategy == "category" and categories is not None and posts is not None:
        from quire.plans.taxonomy import by_category

        return by_category(categories, posts)
    if strategy == "category":
        strategy = "date"
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if entries is None or entries.isEmpty():
        raise ValueError(f"strategy {strategy} needs entries")
    return {"date": by_date, "path": by_path, "flat": by_flat}[strategy](entries)


def orphans(plan: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, seq) of `urls` that the plan hasn't, compared as they are."""
    return urls.join(plan.select("url").distinct(), "url", "left_anti").select("url", "seq")


def rescue_orphans(plan: DataFrame, urls: DataFrame) -> DataFrame:
    """The plan with a last part of the urls it lacks, in order of input."""
    last = plan.agg(F.coalesce(F.max("part_no"), F.lit(0)).alias("last"))
    rest = row_numbers(orphans(plan, urls), [], ["seq", "url"], "pos").crossJoin(F.broadcast(last))
    extra = rest.select(
        (F.col("last") + 1).cast("long").alias("part_no"), F.lit(ORPHANS).alias("part_title"), F.lit(ORPHAN_SLUG).alias("part_slug"), F.lit(1).cast("long").alias("section_no"),
        F.lit(ORPHAN_SECTION).alias("section_title"), F.lit(ORPHAN_SLUG).alias("section_slug"), F.col("pos").cast("long").alias("pos"), "url",
    )
    return plan.unionByName(extra)


def place_of_urls(plan: DataFrame) -> DataFrame:
    """(key, part_title, section_title, rank): for each url key its last place in the plan, as a map would keep it."""
    at = F.struct("part_no", "section_no", "pos")
    return plan.groupBy(U.url_key(F.col("url")).alias("key")).agg(F.max_by(F.struct("part_title", "section_title"), at).alias("v"), F.max(at).alias("rank")).select("key", "v.part_title", "v.section_title", "rank")


def ranked(items: DataFrame, plan: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """`items` with `seq` anew: by their place in the plan, those without one behind, in their former order."""
    p = place_of_urls(plan).select("key", F.col("rank").alias("_rank"))
    j = items.withColumn("_k", U.url_key(F.col(url))).join(p, F.col("_k") == F.col("key"), "left")
    part = F.coalesce(F.col("_rank.part_no"), F.lit(NO_RANK).cast("long"))
    order = [part, F.col("_rank.section_no"), F.col("_rank.pos"), F.col(seq)]
    kept = [c for c in items.columns if c != seq]
    return row_numbers(j.select(*kept, F.col(seq), "_rank"), [], order, "_n").select(*kept, F.col("_n").alias(seq))


def attach(items: DataFrame, plan: DataFrame, url: str = "url") -> DataFrame:
    """`items` with part and section titles, '' where the plan hasn't their url."""
    p = place_of_urls(plan).select("key", F.col("part_title").alias("_p"), F.col("section_title").alias("_s"))
    j = items.withColumn("_k", U.url_key(F.col(url))).join(p, F.col("_k") == F.col("key"), "left")
    return j.select(*items.columns, T.or_empty(F.col("_p")).alias("part_title"), T.or_empty(F.col("_s")).alias("section_title"))


def place_once(plan: DataFrame, chapters: DataFrame) -> DataFrame:
    """Plan rows joined with chapters (url, ...) on the url key, every chapter at its first place only."""
    at = F.struct("part_no", "section_no", "pos")
    cols = [c for c in PLAN if c != "url"]
    first = plan.groupBy(U.url_key(F.col("url")).alias("key")).agg(F.min_by(F.struct(*cols), at).alias("v")).select("key", "v.*")
    return first.join(chapters.withColumn("key", U.url_key(F.col("url"))), "key").drop("key")


def leftovers(plan: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters the plan has no place for."""
    have = plan.select(U.url_key(F.col("url")).alias("key")).distinct()
    return chapters.withColumn("key", U.url_key(F.col("url"))).join(have, "key", "left_anti").drop("key")


def kept(plan: DataFrame, urls: DataFrame) -> DataFrame:
    """Plan rows whose url key is among `urls`; parts and sections left empty vanish."""
    have = urls.select(U.url_key(F.col("url")).alias("key")).distinct()
    return plan.withColumn("key", U.url_key(F.col("url"))).join(have, "key", "left_semi").drop("key")


def renumber(plan: DataFrame) -> DataFrame:
    """The plan with its non-empty parts and sections numbered without gaps."""
    parts = row_numbers(plan.select("part_no").distinct(), [], ["part_no"], "_np")
    sections = row_numbers(plan.select("part_no", "section_no").distinct(), ["part_no"], ["section_no"], "_ns")
    p = plan.join(small(sections.join(small(parts, MAX_PARTS), "part_no"), MAX_PARTS), ["part_no", "section_no"])
    return p.withColumn("part_no", F.col("_np").cast("long")).withColumn("section_no", F.col("_ns").cast("long")).select(*[c for c in p.columns if c not in ("_np", "_ns")])


def round_robin(plan: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows, taken in turn from all sections: one of each, then a second, and so on."""
    turn = row_numbers(plan, ["part_no", "section_no"], ["pos", "url"], "turn")
    return turn.orderBy("turn", "part_no", "section_no").limit(limit).drop("turn")


def rollup(plan: DataFrame, words: DataFrame) -> DataFrame:
    """(part_no, section_no, n_articles, words): sections, parts (section_no NULL) and all (both NULL)."""
    w = words.select(U.url_key(F.col("url")).alias("key"), "words").groupBy("key").agg(F.max("words").alias("words"))
    j = plan.withColumn("key", U.url_key(F.col("url"))).join(w, "key", "left")
    return j.rollup("part_no", "section_no").agg(F.count("*").alias("n_articles"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def summary_lines(plan: DataFrame) -> DataFrame:
    """(part_no, section_no, line): a line a part and one a named section, with their numbers of articles."""
    s = plan.groupBy("part_no", "part_title", "section_no", "section_title").agg(F.count("*").alias("n"))
    parts = s.groupBy("part_no", "part_title").agg(F.sum("n").alias("n")).select("part_no", F.lit(0).cast("long").alias("section_no"), F.format_string("%s  (%d 篇)", F.when(F.col("part_title") != "", F.col("part_title")).otherwise("（全部）"), "n").alias("line"))
    return parts.unionByName(s.where("section_title <> ''").select("part_no", "section_no", F.format_string("    %s  %d 篇", "section_title", "n").alias("line")))


def nested(plan: DataFrame, most: int = MAX_NESTED) -> DataFrame:
    """One row a part with its sections and their urls in order, for a nested file.

    A part gathers in one row, so its size is checked first; beyond `most` urls the flat plan is the form to write.
    """
    largest = plan.groupBy("part_no").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a part has {largest} urls, more than {most}")
    urls = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"])
    s = plan.groupBy("part_no", "part_title", "part_slug", "section_no", "section_title", "section_slug").agg(urls.alias("urls"))
    subs = F.transform(F.array_sort(F.collect_list(F.struct("section_no", F.col("section_title").alias("title"), F.col("section_slug").alias("slug"), "urls"))), lambda x: F.struct(x["title"].alias("title"), x["slug"].alias("slug"), x["urls"].alias("urls")))
    return s.groupBy("part_no", F.col("part_title").alias("title"), F.col("part_slug").alias("slug")).agg(subs.alias("subgroups"))


def pieces(plan: DataFrame, most: int = PIECE) -> DataFrame:
    """(part_no, title, slug, section_no, start, subgroups): one row a section, with at most `most` of its urls from `start` on; longer ones have several."""
    at = F.floor((F.col("pos") - 1) / most)
    urls = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"])
    s = plan.groupBy("part_no", "part_title", "part_slug", "section_no", "section_title", "section_slug", (at * most + 1).alias("start")).agg(urls.alias("urls"))
    sub = F.array(F.struct(F.col("section_title").alias("title"), F.col("section_slug").alias("slug"), "urls"))
    return s.select("part_no", F.col("part_title").alias("title"), F.col("part_slug").alias("slug"), "section_no", "start", sub.alias("subgroups"))


def flat(groups: DataFrame) -> DataFrame:
    """The plan of nested groups (part_no, title, slug, subgroups, and urls where a part has no sections)."""
    own = F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("slug"), F.col("urls").alias("urls"))) if "urls" in groups.columns else F.lit(None)
    sections = F.when(F.size("subgroups") > 0, F.col("subgroups")).otherwise(own) if "urls" in groups.columns else F.col("subgroups")
    s = groups.select("part_no", T.or_empty(F.col("title")).alias("part_title"), T.or_empty(F.col("slug")).alias("part_slug"), F.posexplode(sections).alias("i", "s"))
    u = s.select("part_no", "part_title", "part_slug", (F.col("i") + 1).cast("long").alias("section_no"), T.or_empty(F.col("s.title")).alias("section_title"), T.or_empty(F.col("s.slug")).alias("section_slug"), F.posexplode("s.urls").alias("j", "url"))
    return u.select(F.col("part_no").cast("long").alias("part_no"), "part_title", "part_slug", "section_no", "section_title", "section_slug", (F.col("j") + 1).cast("long").alias("pos"), "url")


def read_json(spark, path: str) -> DataFrame:
    """The plan of a JSON file: {"groups": [...]} or the bare list; anything else is an error."""
    import json

    text = spark.read.text(path, wholetext=True).first()
    data = json.loads(text[0]) if text else None
    groups = data.get("groups") if isinstance(data, dict) else data
    if not isinstance(groups, list):
        raise ValueError(f"no groups in {path}")
    rows = [(i, g.get("title", ""), g.get("slug", ""), [(s.get("title", ""), s.get("slug", ""), s.get("urls") or []) for s in g.get("subgroups") or []], g.get("urls") or []) for i, g in enumerate(groups, 1)]
    kind = "part_no long, title string, slug string, subgroups array<struct<title:string,slug:string,urls:array<string>>>, urls array<string>"
    return flat(spark.createDataFrame(rows, kind))
