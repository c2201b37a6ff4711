"""The stages from addresses to a book, over one archive: fetch, reorder, translate, pack, summary."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.book import cover, epub, frontmatter, toc
from quire.functions import text as T
from quire.functions import url as U
from quire.operators import articles as A
from quire.operators import chunks as C
from quire.operators import titles as TT
from quire.operators.archive import ARTICLE, Archive
from quire.operators.extract import extract
from quire.plans import grouping as G
from quire.session import written
from quire.sources import fetch as FE
from quire.sources.adapters import Registry

# Length of summaries kept, and the confidence below which an article is partial.
SUMMARY_CHARS, MIN_CONFIDENCE = 600, 0.0
#: The width images are shrunk to.
MAX_WIDTH = 900


def fetch_stage(
    spark: SparkSession, archive: Archive, items: DataFrame, transport: FE.Transport, registry: Registry | None = None, plan: DataFrame | None = None, site_name: str = "", order: str = "site",
    limit: int | None = None, force: bool = False, images: bool = False, max_width: int = MAX_WIDTH, min_confidence: float = MIN_CONFIDENCE, delay: float = FE.DELAY, jitter: float = FE.JITTER, robots: bool = True,
) -> DataFrame:
    """Fetch and extract the items (url, seq) that the archive lacks, and enter them; the report of the stage.

    A repeated run fetches only what is missing or failed before. Pages are cached in the archive. With a
    plan, items come in its order.
    """
    began = time.monotonic()
    if plan is not None:
        plan = written(plan, "plan")
        items = G.ranked(items.select("url", "seq"), plan)
    old = archive.table(spark, "articles", ARTICLE)
    known = old.where("fetch_status <> 'failed'") if not force else old.limit(0)
    todo = A.todo(A.first_per_url(items), known, limit)
    cache = archive.table(spark, "cache", None) if (archive.root / "tables/cache").is_dir() else None
    pages = written(FE.fetch(todo, transport, cache, robots, delay=delay, jitter=jitter), "pages")
    fresh = pages.where("ok AND NOT from_cache")
    archive.replace("cache", fresh if cache is None else cache.join(fresh.select("url"), "url", "left_anti").unionByName(fresh))
    got = extract(pages.where("ok").select("url", F.coalesce(F.nullif("text", F.lit("")), F.decode("content", "UTF-8")).alias("html")), registry=registry).drop("html")
    got = written(got.join(todo.select("url", "seq"), "url"), "extracted")
    if images:
        got = _with_images(spark, archive, got, transport, delay, jitter, max_width)
    got = TT.clean_titles(got, F.lit(site_name), "title", [], "seq", "title_")
    got = got.withColumn("title", F.when(F.col("title_") != "", F.col("title_")).otherwise(U.title_of_url(F.col("url")))).drop("title_")
    got = A.ordered(got, order, "seq").withColumn("slug", A.slugs_of(F.col("title"), F.col("url")))
    start = old.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]
    got = A.unique_slugs(got, "slug", "pos", "id", old.select(F.col("id").alias("slug")))
    got = G.attach(got, plan) if plan is not None else got.withColumn("part_title", F.lit("")).withColumn("section_title", F.lit(""))
    idx = (F.col("pos") + start).cast("int")
    assets = F.col("assets") if "assets" in got.columns else F.array().cast("array<string>")
    rows = got.select(
        idx.alias("idx"), "id", "title", F.concat(F.lit("content/"), F.lpad(idx.cast("string"), F.greatest(F.lit(3), F.length(idx.cast("string"))), F.lit("0")), F.lit("-"), "id", F.lit(".md")).alias("file"), F.col("url").alias("source_url"),
        F.when(F.col("author") != "", F.col("author")).otherwise(archive.book.get("author", "")).alias("author"), "published_at", F.substring("summary", 1, SUMMARY_CHARS).alias("summary"), F.array().cast("array<string>").alias("tags"), assets.alias("assets"),
        F.col("word_count").cast("int").alias("word_count"), F.lit(False).alias("translated"), F.lit("").alias("translation_file"), F.when(F.col("confidence") < min_confidence, "partial").otherwise("ok").alias("fetch_status"), F.array_join("notes", "；").alias("notes"),
        F.col("part_title").alias("grp"), F.col("section_title").alias("subgroup"), "markdown",
    )
    rows = written(rows, "rows")
    archive.write_content(rows)
    archive.upsert_articles(spark, rows.drop("markdown"))
    archive.remove_orphans(spark)
    now = archive.table(spark, "articles", ARTICLE)
    if plan is not None:
        archive.write_plan(G.renumber(G.kept(plan, now.select(F.col("source_url").alias("url")))))
    report = _report(pages, got, now, time.monotonic() - began)
    told = report.first()
    archive.set_stats(articles=told.articles_total, words=told.words_total)
    archive.write_report("quality-report", report)
    archive.record_stage("fetch", told.asDict())
    return report


def _with_images(spark: SparkSession, archive: Archive, got: DataFrame, transport: FE.Transport, delay: float, jitter: float, max_width: int) -> DataFrame:
    """Images fetched, shrunk, stored once by content, and named in the texts; their statistics are a report."""
    refs = got.select("url", F.inline(U.image_refs(U.image_sources(F.col("markdown")), F.col("url"))).alias("placeholder", "src")).where(U.is_http(F.col("src")))
    refs = written(refs, "refs")
    pics = FE.fetch(refs.select(F.col("src").alias("url")), transport, delay=delay, jitter=jitter, robots=False)
    pics = written(FE.shrunk(pics, max_width), "images")
    stored = written(FE.stored_images(pics.drop("saved").withColumn("seq", F.xxhash64("url"))), "stored")
    archive.write_report("images", FE.image_stats(pics, stored))
    root = archive.root

    def save(part) -> None:
        for r in part:
            p = root / "assets" / r.name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(bytes(r.content))

    stored.where("name IS NOT NULL").join(pics.select("url", "content"), "url").select("name", "content").dropDuplicates(["name"]).foreachPartition(save)
    sizes = stored.where("name IS NOT NULL").join(pics.select("url", F.length("content").cast("long").alias("size")), "url").groupBy("name").agg(F.max("size").alias("size"), F.min("url").alias("source_url"))
    archive.add_assets(spark, sizes.select(F.concat(F.lit("assets/"), "name").alias("path"), "size", F.lit("image").alias("kind"), "source_url"))
    named = refs.join(stored.where("name IS NOT NULL").select(F.col("url").alias("src"), "name"), "src").groupBy("url").agg(F.array_sort(F.collect_set(F.concat(F.lit("assets/"), "name"))).alias("assets"))
    r = refs.select(F.col("url").alias("id"), "placeholder", F.col("src").alias("url"))
    done = FE.rewrite_images(got.withColumnRenamed("url", "id"), r, stored, "id").withColumnRenamed("id", "url")
    return done.join(named, "url", "left").withColumn("assets", F.coalesce("assets", F.array().cast("array<string>")))


def _report(pages: DataFrame, got: DataFrame, now: DataFrame, seconds: float) -> DataFrame:
    p = pages.agg(F.count("*").alias("fetched"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    e = got.agg(F.count("*").alias("written"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.count_if(F.col("confidence") < A.LOW_CONFIDENCE).alias("low_confidence"))
    n = now.agg(F.count("*").alias("articles_total"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words_total"))
    return p.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(n)).withColumn("elapsed_sec", F.lit(round(seconds, 1)))


def plan_of(spark: SparkSession, archive: Archive, by: str = "auto") -> DataFrame:
    """The archive's plan, or one made of its articles' dates or paths."""
    found = archive.read_plan(spark)
    if found is not None and by == "auto":
        return found
    a = archive.table(spark, "articles", ARTICLE)
    entries = a.select(F.col("source_url").alias("url"), "title", F.col("published_at").alias("date"), F.col("idx").cast("long").alias("seq"))
    return written(G.build_plan(entries, by), "plan")


def reorder(spark: SparkSession, archive: Archive, order: str, dates: DataFrame | None = None) -> DataFrame:
    """Give the articles new numbers and files in an order; extra keys of their frontmatter stay.

    Nothing changes if a text is missing. New files are written before the table that names them,
    and old ones go last, so a crash leaves the former state or the new one: names hold the
    id, so no file takes another article's place.
    """
    a = written(A.reordered(archive.table(spark, "articles", ARTICLE), order, dates), "reordered")
    files = written(archive.content_files(spark), "files")
    lost = a.join(files.select("file"), "file", "left_anti")
    if not lost.isEmpty():
        raise FileNotFoundError(f"no text for {[r.file for r in lost.select('file').orderBy('file').limit(10).collect()]}")
    n = F.col("pos").cast("int")
    j = a.join(files, "file")
    stem = F.concat(F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0")), F.lit("-"), "id", F.lit(".md"))
    new = j.select(*[c for c in a.columns if c not in ("idx", "file", "pos")], n.alias("idx"), F.concat(F.lit("content/"), stem).alias("file"), frontmatter.body(F.col("body")).alias("markdown"))
    new = written(new, "renamed")
    archive.write_content(new)
    archive.replace("articles", new.select([f.name for f in ARTICLE]))
    archive.remove_orphans(spark)
    return archive.table(spark, "articles", ARTICLE)


def prepared(spark: SparkSession, archive: Archive, only: list[str] | None = None, skip_translated: bool = True) -> DataFrame:
    """The chunks of an archive's articles: of those named by `only`, without those translated before."""
    texts = archive.read_content(spark)
    if skip_translated:
        texts = texts.where("NOT translated")
    if only is not None:
        texts = texts.where(F.col("id").isin(*only) if only else F.lit(False))
    return written(C.prepare(written(texts.select("id", "title", "summary", frontmatter.body(F.col("body")).alias("body")), "to-translate")), "chunks")


def translate(spark: SparkSession, archive: Archive, dest: str, translator: Callable[[str], str] | DataFrame, bilingual: bool = False, strict: bool = False, only: list[str] | None = None, skip_translated: bool = True) -> tuple[Archive, DataFrame]:
    """A copy of the archive with translated texts, and what each article got.

    `translator` takes a text, or is a table (id, text) of chunks translated elsewhere. With `strict`,
    articles with problems stay as they are. `only` names the ids to translate; articles translated
    before are left unless `skip_translated` is off.
    """
    ch = prepared(spark, archive, only, skip_translated)
    texts = translator if isinstance(translator, DataFrame) else C.translate(ch, translator)
    done = written(C.apply(ch, texts, bilingual), "translated")
    out = archive.clone_to(spark, dest)
    use = done.where((F.size("problems") == 0) & (F.size("missing") == 0)) if strict else done
    a = archive.table(spark, "articles", ARTICLE)
    new = a.join(use.select(F.col("article").alias("id"), F.col("body").alias("markdown"), "heads"), "id")
    new = new.withColumn("title", F.coalesce(F.try_element_at("heads", F.lit(1)), F.col("title"))).withColumn("translated", F.lit(True)).withColumn("translation_file", F.col("file"))
    out.write_content(new.drop("heads"))
    out.upsert_articles(spark, new.select([f.name for f in ARTICLE]))
    return out, done.drop("body")


def style_of(spark: SparkSession, book: dict, articles: int, words: int) -> str:
    """The cover's style for a book of so many articles and words."""
    row = spark.createDataFrame([(book.get("title", ""), book.get("subtitle", ""), book.get("description", ""), articles, words)], "t string, s string, d string, n long, w long")
    return row.select(cover.recommend_style(F.col("t"), F.col("s"), F.col("d"), F.col("n"), F.col("w"))).first()[0]


def pack(spark: SparkSession, archive: Archive, path: str, by: str = "auto", theme: str = "classic", style: str = "auto") -> dict:
    """The archive as an EPUB with its plan, index and cover."""
    book = archive.book
    texts = archive.read_content(spark)
    ch = texts.select(F.col("source_url").alias("url"), "title", "idx", frontmatter.body(F.col("body")).alias("markdown"), "word_count")
    ch = written(A.title_suffixes(ch).withColumn("title", F.col("shown")).drop("shown"), "chapters")
    plan = plan_of(spark, archive, by)
    n, words = ch.agg(F.count("*"), F.coalesce(F.sum("word_count"), F.lit(0))).first()
    style = style_of(spark, book, n, words) if style == "auto" else style
    assets = archive.root / "assets"
    pics = {p.name: p for p in assets.iterdir()} if assets.is_dir() else {}
    out = epub.publish(written(toc.spine(plan, ch), "spine"), ch, path, book, theme, cover.svg(book.get("title", ""), book.get("author", ""), book.get("subtitle", ""), style), pics)
    lines = toc.index_lines(plan, archive.table(spark, "articles", ARTICLE)).orderBy("part_no", "section_no", "idx")
    (archive.root / "index.md").write_text("\n".join([f"# {book.get('title', '')}", "", f"- **作者**：{book.get('author') or '—'}", f"- **章节数**：{n}", f"- **总字数**：约 {words:,}", f"- **排版主题**：{theme}", "", "## 目录", "", *(r.line for r in lines.toLocalIterator())]) + "\n", "utf-8")
    return out | {"problems": [x for p in out["volumes"] for x in epub.validate(p)]}


def summary(report: dict, packed: dict, archive: Archive) -> dict:
    """What a build did, and what to do next."""
    s = {"archive": str(archive.root), **{k: report.get(k) for k in ("fetched", "ok", "failed", "articles_total", "words_total", "low_confidence", "elapsed_sec")}, "epub": packed.get("path"), "epub_size": packed.get("bytes"), "problems": packed.get("problems", [])}
    hints = [("failed", "run again to fetch what failed"), ("low_confidence", "look at the articles with low confidence")]
    s["next_actions"] = [h for k, h in hints if s.get(k)] + (["check the book"] if s["problems"] else [])
    return s


def build(spark: SparkSession, items: DataFrame, transport: FE.Transport, root: str, out: str, book: dict, by: str = "auto", theme: str = "classic", style: str = "auto", **options) -> dict:
    """Fetch, plan, pack and sum up; problems of single pages don't stop it."""
    archive = Archive(root, book)
    report = fetch_stage(spark, archive, items, transport, **options).first().asDict()
    packed = pack(spark, archive, out, by, theme, style)
    s = summary(report, packed, archive)
    archive._write("reports/summary.json", s)
    return s


def build_site(spark: SparkSession, url: str, transport: FE.Transport, root: str, out: str, book: dict, by: str = "auto", registry: Registry | None = None, limit: int = 0, **options) -> dict:
    """A book of a site: it is asked what it is, and its interface, feed, sitemap or links give the items.

    A site with a REST interface has a plan by category, with a last part of what no category places.
    """
    from quire.plans import taxonomy
    from quire.sources import items as IT
    from quire.sources.probe import probe

    def get(u: str) -> str | None:
        a = transport(u)
        return (a.text or a.content.decode("utf-8", "replace")) if a.status == 200 else None

    p = probe(get, url, registry)
    book = {"title": p.title, "author": p.author, "description": p.description, "language": p.language} | {k: v for k, v in book.items() if v}
    pace = {k: options[k] for k in ("delay", "jitter", "robots") if k in options}
    plan = None
    if p.api_root and by in ("auto", "category"):
        categories, posts = IT.from_rest(spark, transport, url)
        found = taxonomy.site_entries(posts)
        plan = written(G.rescue_orphans(taxonomy.by_category(categories, posts).drop("site"), found.select("url", "seq")), "plan")
        if limit:
            plan = written(G.round_robin(plan, limit), "plan")
        items = found.join(plan.select("url").distinct(), "url", "left_semi").select("url", "seq")
    else:
        kind = {"feed": "feeds", "sitemap": "sitemaps"}.get(p.kind, "entries")
        items = IT.gather(spark, transport, **{kind: p.entry_urls}, limit=limit, **pace)
    return build(spark, written(items.select("url", "seq"), "items"), transport, root, out, book, "auto" if plan is not None else by, plan=plan, registry=registry, site_name=p.title, **options)
