"""The archive's articles: identity, numbering, order, upserts, audit and reports.

An article is a row with article_no, idx, id, title, file, source_url, author, published_at,
summary, tags, assets, word_count, translated, translation_file, fetch_status, notes, grp,
subgroup. Missing strings are ''; dates are strings of varying precision and compare as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import or_empty, slugify
from quire.functions.url import site, url_key
from quire.operators.ranking import row_numbers

# Thresholds of notes and reports, and the place of undated articles.
LOW_CONFIDENCE, FEW_WORDS, DOUBTFUL = 0.6, 80, 0.5
LAST_DATE, FIRST_DATE = "9999", "0000"
ORDERS = ("site", "reverse", "alpha", "date-asc", "date-desc")


def latest(articles: DataFrame, key: str = "article_no") -> DataFrame:
    """One row a key: of repeated ones the best fetch (ok, partial, skipped, failed), then the greatest by value."""
    rank = F.when(F.col("fetch_status") == "ok", 3).when(F.col("fetch_status") == "partial", 2).when(F.col("fetch_status") == "skipped", 1).otherwise(0)
    cols = [c for c in articles.columns if c != key]
    return articles.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(rank, F.xxhash64(*cols))).alias("v")).select(key, "v.*").select(articles.columns)


def first_per_url(items: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """Items with web addresses, the first of each url key."""
    rest = [c for c in items.columns]
    ok = items.where(or_empty(F.col(url)).rlike("^https?://"))
    return ok.groupBy(url_key(F.col(url)).alias("_k")).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("v")).select("v.*")


def todo(items: DataFrame, known: DataFrame, limit: int | None = None, url: str = "url", known_url: str = "source_url", seq: str = "seq") -> DataFrame:
    """Items not yet in the archive. The limit counts before the known are dropped, so a repeated run with it fetches nothing new."""
    if limit:
        items = items.orderBy(seq).limit(limit)
    have = known.select(url_key(F.col(known_url)).alias("_k")).distinct()
    return items.withColumn("_k", url_key(F.col(url))).join(have, "_k", "left_anti").drop("_k")


def number(items: DataFrame, order: list, start: int = 0, out: str = "idx") -> DataFrame:
    """Numbers from start + 1 in the given order."""
    return row_numbers(items, [], order, "_n").withColumn(out, (F.col("_n") + start).cast("long")).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def unique_slugs(items: DataFrame, slug: str = "slug", seq: str = "seq", out: str = "id", used: DataFrame | None = None) -> DataFrame:
    """`items` with `out`: the slug, or the first of slug-2, slug-3, ... that no earlier item has taken.

    `used` (slug) are taken from the start. Slugs that can't meet are named without gathering a group: where
    no other of their stem carries a number they are ranked, and those that neither repeat themselves nor
    continue one that does keep their slug. The rest stream in order, a stem at a time, with only the
    numbers taken in memory; a stem whose plain slug repeats beside numbered ones is one task's work.
    """
    rows = items.select(F.col(seq).alias("seq"), F.col(slug).alias("slug"))
    if used is not None:
        rows = rows.withColumn("old", F.lit(False)).unionByName(used.select(F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), F.col("slug"), F.lit(True).alias("old")))
    else:
        rows = rows.withColumn("old", F.lit(False))
    stem = F.regexp_replace("slug", r"(?:-\d+)+$", "")
    rows = rows.withColumn("stem", F.when(stem != "", stem).otherwise(F.col("slug")))
    numbered = rows.where((F.col("slug") != F.col("stem")) | F.col("old")).select("stem").distinct()
    calm = row_numbers(rows.join(numbered, "stem", "left_anti"), ["slug"], ["seq"], "n")
    calm = calm.select("seq", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string"))).alias(out))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken, upto = None, set(), {}

        def free(name: str) -> bool:
            if name in taken:
                return False
            base, _, n = name.rpartition("-")
            return not (n.isdigit() and base in upto and str(int(n)) == n and 2 <= int(n) < upto[base])

        for pdf in batches:
            got = []
            for st, s, q, old in zip(pdf["stem"], pdf["slug"], pdf["seq"], pdf["old"]):
                if st != current:
                    current, taken, upto = st, set(), {}
                if old:
                    taken.add(s)
                    continue
                if free(s):
                    taken.add(s)
                    got.append((q, s))
                    continue
                n = upto.get(s, 2)
                while f"{s}-{n}" in taken or not free(f"{s}-{n}"):
                    n += 1
                upto[s] = n + 1  # all of 2..n are taken now, here or by others
                got.append((q, f"{s}-{n}"))
            yield pd.DataFrame(got, columns=["seq", out])

    # a slug meets others if it, or one that it continues by numbers, is taken more than once
    some = rows.join(numbered, "stem", "left_semi")
    twice = rows.groupBy("slug").agg(((F.count("*") > 1) | F.max("old")).alias("twice")).where("twice").select(F.col("slug").alias("base"))
    ends = F.size(F.split(F.regexp_extract("slug", r"((?:-\d+)*)$", 1), "-")) - 1
    bases = F.transform(F.sequence(F.lit(0), ends), lambda k: F.regexp_replace("slug", F.concat(F.lit(r"(?:-\d+){"), k.cast("string"), F.lit("}$")), F.lit("")))
    touched = some.select("slug").distinct().select("slug", F.explode(bases).alias("base")).join(twice, "base", "left_semi").select("slug").distinct()
    alone = some.where("NOT old").join(touched, "slug", "left_anti").select("seq", F.col("slug").alias(out))
    # by a hash of the stem: a union of parts hashed by the stem itself would count as spread already
    met = some.join(touched, "slug", "left_semi").select(rows.columns).repartition(F.xxhash64("stem")).sortWithinPartitions("stem", F.col("old").desc(), "seq")
    kind = rows.schema["seq"].dataType.simpleString()
    names = calm.unionByName(alone).unionByName(met.mapInPandas(run, f"seq {kind}, {out} string"))
    return items.join(names.withColumnRenamed("seq", "_seq"), F.col(seq) == F.col("_seq")).drop("_seq")


def slugs_of(titles: Column, urls: Column) -> Column:
    """The slug an article's id begins with: of its title, up to 48 characters."""
    s = slugify(titles, 48)
    return F.when(s != "", s).otherwise(F.substring(F.sha1(or_empty(urls)), 1, 8))


def ordered(items: DataFrame, order: str, seq: str = "seq", out: str = "pos") -> DataFrame:
    """`items` (title, published_at) with their place under an order; ties keep the order of input."""
    date = or_empty(F.col("published_at"))
    keys = {
        "site": [seq], "reverse": [(seq, "desc")], "alpha": [F.lower("title"), seq],
        "date-asc": [F.when(date == "", LAST_DATE).otherwise(date), seq], "date-desc": [(F.when(date == "", FIRST_DATE).otherwise(date), "desc"), seq],
    }
    if order not in keys:
        raise ValueError(f"unknown order: {order}")
    return row_numbers(items, [], keys[order], out)


def reordered(articles: DataFrame, order: str, dates: DataFrame | None = None, out: str = "pos") -> DataFrame:
    """Articles with a new place. `dates` (id, date) fill missing dates only.

    date-desc compares years and months; dates that aren't numbers follow the dated ones, then come
    the undated; ties keep the present order.
    """
    a = articles
    if dates is not None:
        a = a.join(dates.select("id", F.col("date").alias("_d")), "id", "left").withColumn("published_at", F.when(or_empty(F.col("published_at")) == "", or_empty(F.col("_d"))).otherwise(F.col("published_at"))).drop("_d")
    if order != "date-desc":
        return ordered(a, order, "idx", out)
    d = or_empty(F.col("published_at"))
    year, month = F.regexp_extract(d, r"^\s*(\d+)\s*(?:-|$)", 1), F.regexp_extract(d, r"^\s*\d+\s*-\s*(\d+)\s*(?:-|$)", 1)
    good = (year != "") & ((month != "") | ~d.contains("-"))
    month = F.when(month == "", "0").otherwise(month)
    value = F.when(good, F.try_to_number(F.substring(year, 1, 9), F.lit("999999999")) * 100 + F.try_to_number(F.substring(month, 1, 9), F.lit("999999999"))).otherwise(0)
    return row_numbers(a, [], [F.when(d == "", 1).otherwise(0), (value.cast("long"), "desc"), "idx"], out)


def fill_extras(meta: Column, extras: Column) -> Column:
    """Two string maps as one; keys of `meta` win."""
    return F.map_concat(F.map_filter(extras, lambda k, v: ~F.map_contains_key(meta, k)), meta)


def title_suffixes(chapters: DataFrame, title: str = "title", seq: str = "idx", out: str = "shown") -> DataFrame:
    """Titles with （n） behind the second and later of the same."""
    n = row_numbers(chapters, [title], [seq], "_n")
    return n.withColumn(out, F.when(F.col("_n") > 1, F.concat(F.col(title), F.lit("（"), F.col("_n").cast("string"), F.lit("）"))).otherwise(F.col(title))).drop("_n")


def dedupe_by_content(files: DataFrame, content: str, name: str, seq: str, out: str = "stored") -> DataFrame:
    """`files` with the name under which equal content is stored: the first one's."""
    h = F.sha1(F.col(content))
    first = files.groupBy(h.alias("_h")).agg(F.min_by(F.col(name), F.col(seq)).alias(out))
    return files.withColumn("_h", h).join(first, "_h").drop("_h")


def audit(articles: DataFrame, files: DataFrame, assets: DataFrame) -> DataFrame:
    """(level, article, msg): what is wrong between the articles and what is stored.

    `files` (file, body) and `assets` (path) are what exists. An empty archive is one error.
    """
    a = articles.select("idx", "id", "file", "assets", "fetch_status", or_empty(F.col("notes")).alias("notes"))

    def issue(df: DataFrame, level: str, msg: Column) -> DataFrame:
        return df.select(F.lit(level).alias("level"), F.col("id").alias("article"), msg.alias("msg"))

    twice = a.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("n"))))
    empty = a.join(files.where(F.trim(or_empty(F.col("body"))) == "").select("file"), "file", "left_semi")
    lost = a.select("id", F.explode("assets").alias("path")).join(assets.select("path").distinct(), "path", "left_anti")
    out = (
        issue(twice, "error", F.lit("id 重复"))
        .unionByName(issue(a.join(files.select("file").distinct(), "file", "left_anti"), "error", F.concat(F.lit("正文文件缺失："), "file")))
        .unionByName(issue(empty, "warn", F.lit("正文为空")))
        .unionByName(issue(lost, "warn", F.concat(F.lit("资源缺失："), "path")))
        .unionByName(issue(a.where("fetch_status = 'failed'"), "error", F.lit("抓取失败")))
        .unionByName(issue(a.where("fetch_status = 'partial'"), "warn", F.when(F.col("notes") != "", F.col("notes")).otherwise("抓取不完整")))
    )
    none = a.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("error").alias("level"), F.lit("-").alias("article"), F.lit("归档包内没有文章").alias("msg"))
    return out.unionByName(none)


def audit_levels(issues: DataFrame) -> DataFrame:
    """One row (errors, warnings)."""
    return issues.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))


def orphan_files(files: DataFrame, articles: DataFrame) -> DataFrame:
    """Stored files no article names."""
    return files.join(articles.select("file").distinct(), "file", "left_anti")


def histogram(df: DataFrame, c: str, seq: str) -> DataFrame:
    """(c, n, first): counts of values and where each is first seen; the mode is the greatest n, the earliest among equals."""
    return df.groupBy(F.col(c)).agg(F.count("*").alias("n"), F.min(seq).alias("first"))


def mode(hist: DataFrame, c: str) -> DataFrame:
    return hist.agg(F.max_by(F.col(c), F.struct("n", -F.col("first"))).alias(c))


def quality_report(extracts: DataFrame, articles: DataFrame) -> DataFrame:
    """One row of totals: fetched, ok, failed, words, images, low confidence."""
    e = extracts.agg(F.count("*").alias("extracted"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words_total"), F.coalesce(F.sum(F.size(F.coalesce("images", F.array().cast("array<string>")))), F.lit(0)).alias("images_localized"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE).alias("low_confidence"))
    a = articles.agg(F.count("*").alias("fetched"), F.count_if(F.col("fetch_status") == "failed").alias("failed"), F.count_if(F.col("fetch_status") != "failed").alias("ok"))
    return a.crossJoin(F.broadcast(e))


def notes_of(confidence: Column, words: Column, strategy: Column) -> Column:
    """The notes of an extraction: doubtful place, too short."""
    doubtful = F.when((confidence < DOUBTFUL) & ~or_empty(strategy).startswith("adapter:"), F.concat(F.lit("正文定位置信度偏低（"), confidence.cast("string"), F.lit("，策略 "), strategy, F.lit("），建议人工抽查")))
    short = F.when(words < FEW_WORDS, F.lit("正文过短，可能未正确识别正文区域"))
    return F.array_compact(F.array(doubtful, short))


def failure_reasons(fetches: DataFrame) -> DataFrame:
    """(reason, n): why fetches failed. A forbidden page is robots, a status 0 the network."""
    reason = F.when(F.lower(or_empty(F.col("error"))).contains("robots"), "robots").when(F.coalesce("status", F.lit(0)) > 0, F.concat(F.lit("http-"), F.col("status").cast("string"))).otherwise("network")
    return fetches.where("NOT ok").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def sources(articles: DataFrame, limit: int = 8) -> DataFrame:
    """The first hosts of the articles, by name."""
    return articles.select(site(F.col("source_url")).alias("host")).where("host <> ''").distinct().orderBy("host").limit(limit)
