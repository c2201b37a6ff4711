"""Tables of contents and the index of a book, from a plan and its chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import cn_number, or_empty
from quire.operators.ranking import row_numbers
from quire.plans import grouping as G

OTHER = "其他"


def index_line(idx: Column, title: Column, file: Column, date: Column, words: Column) -> Column:
    """One article's line: number, link, date and words, the last two where known."""
    extra = F.array_compact(F.array(F.when(or_empty(date) != "", date), F.when(words > 0, F.concat(F.format_number(words, 0), F.lit(" 字")))))
    tail = F.when(F.size(extra) > 0, F.concat(F.lit(" —— "), F.array_join(extra, " · "))).otherwise("")
    return F.concat(F.lpad(idx.cast("string"), F.greatest(F.lit(3), F.length(idx.cast("string"))), F.lit(" ")), F.lit(". ["), or_empty(title), F.lit("]("), or_empty(file), F.lit(")"), tail)


def index_lines(plan: DataFrame, articles: DataFrame) -> DataFrame:
    """(part_no, section_no, idx, line) in the order of the index: headings at idx 0, then articles; what the plan lacks comes last.

    `articles` have source_url, idx, title, file, published_at, word_count. Each stands once.
    """
    a = articles.select(F.col("source_url").alias("url"), "idx", index_line(F.col("idx"), F.col("title"), F.col("file"), F.col("published_at"), F.col("word_count")).alias("line"))
    placed = G.place_once(plan, a)
    n_sections = plan.groupBy("part_no", "part_title").agg(F.count_distinct("section_no").alias("n_s"), F.count("*").alias("n"))
    heads = n_sections.select("part_no", F.lit(0).cast("long").alias("section_no"), F.lit(0).cast("int").alias("idx"), F.concat(F.lit("### "), F.when(F.col("part_title") != "", F.col("part_title")).otherwise("（全部）"), F.format_string("（%d 篇）", "n")).alias("line"))
    named = placed.where("section_title <> ''").groupBy("part_no", "section_no", "section_title").agg(F.count("*").alias("n")).join(n_sections.where("n_s > 1").select("part_no"), "part_no")
    subs = named.select("part_no", "section_no", F.lit(0).cast("int").alias("idx"), F.concat(F.lit("#### "), "section_title", F.format_string("（%d 篇）", "n")).alias("line"))
    rest = G.leftovers(plan, a)
    last = F.lit(1 << 40)
    other = rest.agg(F.count("*").alias("n")).where("n > 0").select(last.alias("part_no"), F.lit(0).cast("long").alias("section_no"), F.lit(0).cast("int").alias("idx"), F.concat(F.lit(f"### {OTHER}"), F.format_string("（%d 篇）", "n")).alias("line"))
    rows = placed.select("part_no", "section_no", F.col("idx").cast("int").alias("idx"), "line").unionByName(rest.select(last.alias("part_no"), F.lit(1).cast("long").alias("section_no"), F.col("idx").cast("int").alias("idx"), "line"))
    return heads.unionByName(subs).unionByName(rows).unionByName(other)


def numbered(plan: DataFrame, chapters: DataFrame) -> DataFrame:
    """Placed chapters with part and section numbers of what isn't empty, and part_label 第…部; single sections have no page (section_page false)."""
    placed = G.renumber(G.place_once(plan, chapters))
    n = placed.groupBy("part_no").agg(F.count_distinct("section_no").alias("_n"))
    out = placed.join(n, "part_no").withColumn("section_page", F.col("_n") > 1).drop("_n")
    label = F.concat(F.lit("第"), cn_number(F.col("part_no")), F.lit("部"))
    return out.withColumn("part_label", label).withColumn("part_title", F.when(F.col("part_title") != "", F.col("part_title")).otherwise(F.concat(F.lit("第"), F.col("part_no").cast("string"), F.lit("部"))))


def spine(plan: DataFrame, chapters: DataFrame) -> DataFrame:
    """(spine_no, kind, part_no, section_no, url, title): part pages, section pages and chapters in reading order, then what the plan lacks by url."""
    p = numbered(plan, chapters)
    rows = p.select(F.lit("chapter").alias("kind"), "part_no", "section_no", F.col("pos").alias("o"), "url", "title")
    parts = p.groupBy("part_no").agg(F.min("part_title").alias("title")).select(F.lit("part").alias("kind"), "part_no", F.lit(0).cast("long").alias("section_no"), F.lit(0).cast("long").alias("o"), F.lit("").alias("url"), "title")
    secs = p.where("section_page").groupBy("part_no", "section_no").agg(F.min("section_title").alias("t")).select(F.lit("section").alias("kind"), "part_no", "section_no", F.lit(0).cast("long").alias("o"), F.lit("").alias("url"), F.when(F.col("t") != "", F.col("t")).otherwise(F.concat(F.lit("第"), F.col("section_no").cast("string"), F.lit("章"))).alias("title"))
    rest = G.leftovers(plan, chapters).select(F.lit("chapter").alias("kind"), F.lit(1 << 40).alias("part_no"), F.lit(0).cast("long").alias("section_no"), F.lit(1).cast("long").alias("o"), "url", "title")
    return row_numbers(parts.unionByName(secs).unionByName(rows).unionByName(rest), [], ["part_no", "section_no", "o", "url"], "spine_no").select("spine_no", "kind", "part_no", "section_no", "url", "title")
