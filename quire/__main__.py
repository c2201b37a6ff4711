"""python -m quire: sites and archives into books, from the command line."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import os
import shutil
import sys
from pathlib import Path

BY = ["auto", "category", "date", "path", "flat"]
STYLES = ["auto", "editorial", "classic", "minimal", "band"]
ORDERS = ["date-asc", "date-desc", "alpha", "reverse"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="documents into books, on Spark")
    p.add_argument("--json", action="store_true", help="print results as JSON")
    p.add_argument("--quiet", action="store_true", help="print nothing but results")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=about)

    def fetching(c: argparse.ArgumentParser) -> None:
        c.add_argument("--urls-file", default="", help="file with an address a line")
        c.add_argument("--sitemap", action="append", default=[])
        c.add_argument("--feed", action="append", default=[])
        c.add_argument("--entry", action="append", default=[], help="page with links, a sitemap or a feed")
        c.add_argument("--include", default="")
        c.add_argument("--exclude", default="")
        c.add_argument("--any-host", action="store_true", help="links to other hosts too")
        c.add_argument("--max", type=int, default=0)
        c.add_argument("--order", default="site", choices=["site", *ORDERS])
        c.add_argument("--force", action="store_true", help="fetch what the archive has, too")
        c.add_argument("--images", action="store_true")
        c.add_argument("--image-max-width", type=int, default=900)
        c.add_argument("--delay", type=float, default=0.6)
        c.add_argument("--no-robots", action="store_true")
        c.add_argument("--adapters", action="append", default=[])

    def named(c: argparse.ArgumentParser) -> None:
        for key in ("title", "subtitle", "author", "publisher", "description", "rights"):
            c.add_argument(f"--{key}", default="")

    q = command("query", "run a registered query")
    q.add_argument("name")
    q.add_argument("data", help="folder with the tables")
    q.add_argument("-o", "--out", help="write Parquet there instead of showing rows")
    command("queries", "list registered queries")
    g = command("group", "plan the articles of an archive or a folder of tables")
    g.add_argument("data")
    g.add_argument("--by", default="auto", choices=BY)
    g.add_argument("--theme-order", default="", help="slugs of parts that come first")
    g.add_argument("--section-order", default="")
    g.add_argument("--max", type=int, default=0, help="take so many articles from all sections in turn")
    k = command("pack", "write the book of an archive or of a folder of tables")
    k.add_argument("data")
    k.add_argument("-o", "--out", required=True)
    k.add_argument("--by", default="auto", choices=BY)
    k.add_argument("--theme", default="classic")
    k.add_argument("--cover-style", default="auto", choices=STYLES)
    named(k)
    v = command("check", "check an EPUB file")
    v.add_argument("file")
    f = command("fetch", "fetch what an archive lacks")
    f.add_argument("archive")
    f.add_argument("--plan", default="", help="JSON file with the plan")
    fetching(f)
    named(f)
    b = command("build", "a site or a list of addresses into an archive and its book")
    b.add_argument("source", help="address of a site, or a file with an address a line")
    b.add_argument("--archive", required=True)
    b.add_argument("-o", "--out", required=True)
    b.add_argument("--by", default="auto", choices=BY)
    b.add_argument("--theme", default="classic")
    b.add_argument("--cover-style", default="auto", choices=STYLES)
    fetching(b)
    named(b)
    r = command("reorder", "number an archive's articles anew")
    r.add_argument("archive")
    r.add_argument("--order", required=True, choices=ORDERS)
    c = command("cover", "draw a cover")
    c.add_argument("-o", "--out", required=True)
    c.add_argument("--archive", default="", help="take the book's title, author and size from there")
    c.add_argument("--style", default="auto", choices=STYLES)
    named(c)
    t = command("translate", "a translated copy of an archive")
    t.add_argument("archive")
    t.add_argument("dest")
    t.add_argument("--endpoint", default="", help="address of a chat service; without one only the chunks are counted")
    t.add_argument("--model", default="")
    t.add_argument("--lang", default="zh-CN")
    t.add_argument("--key-variable", default="QUIRE_TRANSLATOR_KEY", help="environment variable with the service's key")
    t.add_argument("--glossary", default="", help="JSON file of words")
    t.add_argument("--only", default="", help="ids of articles, with commas")
    t.add_argument("--again", action="store_true", help="translated articles too")
    t.add_argument("--bilingual", action="store_true")
    t.add_argument("--strict", action="store_true", help="articles with problems stay as they are")
    t.add_argument("--export", default="", help="write the chunks there for translation elsewhere, and stop")
    t.add_argument("--import", dest="import_", default="", help="apply translated chunks from there")
    i = command("info", "find out what a site is")
    i.add_argument("url")
    i.add_argument("--adapters", action="append", default=[])
    a = command("adapters", "list the adapters of sites")
    a.add_argument("--adapters", action="append", default=[])
    a.add_argument("--match", default="", help="an address: which adapter is its")
    d = command("doctor", "look whether everything needed is there")
    d.add_argument("--adapters", action="append", default=[])
    command("themes", "list themes")
    return p


def registered() -> dict:
    """All queries, those of optional subpackages too, where the driver's entry module can be found."""
    if importlib.util.find_spec("__spark_entry__"):
        return importlib.import_module("__spark_entry__").queries()
    from quire.queries import QUERIES

    return QUERIES


def registry_of(extra: list[str]):
    from quire.sources import adapters

    registry = adapters.Registry([adapters.WordPress()])
    adapters.load(registry, adapters.search_paths(extra))
    return registry


def doctor(extra: list[str]) -> list[dict]:
    """(what, found, needed) of everything that a command may need."""
    rows = [{"what": "python", "found": sys.version.split()[0], "needed": True}]
    for name, needed in (("pyspark", True), ("pyarrow", True), ("pandas", True), ("yaml", False), ("PIL", False)):
        spec = importlib.util.find_spec(name)
        rows.append({"what": name, "found": (getattr(importlib.import_module(name), "__version__", "yes") if spec else ""), "needed": needed})
    rows.append({"what": "java", "found": os.environ.get("JAVA_HOME", "") or shutil.which("java") or "", "needed": True})
    rows.append({"what": "adapters", "found": ", ".join(registry_of(extra).names()), "needed": False})
    return rows


def main(argv: list[str] | None = None, transport=None) -> int:
    """`transport` stands in for the network."""
    a = parser().parse_args(argv)

    def say(x: object) -> None:
        print(json.dumps(x, ensure_ascii=False, default=str) if a.json or not isinstance(x, str) else x)

    if a.command == "themes":
        from quire.book.typeset import CSS

        say(sorted(CSS))
        return 0
    if a.command == "check":
        from quire.book.epub import validate

        found = validate(a.file)
        say(found)
        return int(bool(found))
    if a.command == "queries":
        say(sorted(registered()))
        return 0
    if a.command == "adapters":
        registry = registry_of(a.adapters)
        found = registry.find(a.match) if a.match else None
        say((found.name if found else "") if a.match else registry.summary())
        return int(bool(a.match) and found is None)
    if a.command == "doctor":
        rows = doctor(a.adapters)
        for r in [rows] if a.json else rows:
            say(r if a.json else f"{'ok' if r['found'] else 'MISSING' if r['needed'] else '-':8s}{r['what']:10s}{r['found']}")
        return int(any(r["needed"] and not r["found"] for r in rows))
    from quire.sources import fetch

    ask = transport or fetch.http_transport()
    if a.command == "info":
        from dataclasses import asdict

        from quire.sources import probe

        say(asdict(probe.probe(lambda u: x.text if (x := ask(u)).status == 200 else None, a.url, registry_of(a.adapters))))
        return 0
    from quire.session import get_session

    return with_spark(a, get_session(), ask, say)


def with_spark(a: argparse.Namespace, spark, ask, say) -> int:
    """The commands that need a session."""
    from pyspark.sql import functions as F

    from quire import build
    from quire.book import cover
    from quire.operators.archive import ARTICLE, Archive
    from quire.plans import grouping, taxonomy
    from quire.session import table
    from quire.sources import items as IT

    book = {k: getattr(a, k, "") for k in ("title", "subtitle", "author", "publisher", "description", "rights")}
    archived = hasattr(a, "data") and (Path(a.data) / "tables").is_dir()

    def options() -> dict:
        return {"order": a.order, "limit": a.max or None, "force": a.force, "images": a.images, "max_width": a.image_max_width, "robots": not a.no_robots, "delay": a.delay}

    def items():
        return IT.gather(spark, ask, a.urls_file, a.sitemap, a.feed, a.entry, not a.any_host, a.include, a.exclude, a.max, delay=a.delay, robots=not a.no_robots)

    if a.command == "query":
        df = registered()[a.name](spark, a.data)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(truncate=80)
    elif a.command == "fetch":
        plan = grouping.read_json(spark, a.plan) if a.plan else None
        say(build.fetch_stage(spark, Archive(a.archive, book), items(), ask, registry_of(a.adapters), plan, book["title"], **options()).first().asDict())
    elif a.command == "build":
        said = {"registry": registry_of(a.adapters), **options()}
        if a.source.startswith(("http://", "https://")):
            limit = said.pop("limit") or 0
            say(build.build_site(spark, a.source, ask, a.archive, a.out, book, a.by, limit=limit, theme=a.theme, style=a.cover_style, **said))
        else:
            a.urls_file = a.source
            say(build.build(spark, items(), ask, a.archive, a.out, {**book, "title": book["title"] or "Collected articles"}, a.by, a.theme, a.cover_style, **said))
    elif a.command == "reorder":
        for r in build.reorder(spark, Archive(a.archive), a.order).orderBy("idx").toLocalIterator():
            say(f"{r.idx:4d} {r.published_at or '—'} {r.title}")
    elif a.command == "cover":
        n = words = 0
        if a.archive:
            ar = Archive(a.archive)
            book = ar.book | {k: v for k, v in book.items() if v}
            n, words = ar.table(spark, "articles", ARTICLE).agg(F.count("*"), F.coalesce(F.sum("word_count"), F.lit(0))).first()
        style = build.style_of(spark, book, n, words) if a.style == "auto" else a.style
        Path(a.out).write_text(cover.svg(book.get("title", ""), book.get("author", ""), book.get("subtitle", ""), style), "utf-8")
        say({"path": a.out, "style": style})
    elif a.command == "translate":
        return translated(a, spark, say)
    elif archived and a.command == "group":
        for r in grouping.summary_lines(build.plan_of(spark, Archive(a.data), a.by)).orderBy("part_no", "section_no").toLocalIterator():
            say(r.line)
    elif archived:
        out = build.pack(spark, Archive(a.data, book), a.out, a.by, a.theme, a.cover_style)
        say(out)
        return int(bool(out["problems"]))
    else:
        from quire.book import epub, toc
        from quire.operators.articles import latest
        from quire.session import written

        arts = latest(table(spark, a.data, "articles"))
        entries = arts.select(F.col("source_url").alias("url"), "title", F.col("published_at").alias("date"), F.col("article_no").alias("seq"))
        if a.by == "category":
            orders = {k: [x.strip() for x in getattr(a, k, "").split(",") if x.strip()] for k in ("theme_order", "section_order")}
            plan = taxonomy.by_category(table(spark, a.data, "categories"), table(spark, a.data, "posts"), **orders).drop("site")
        else:
            plan = grouping.build_plan(entries, a.by)
        if a.command == "group":
            plan = grouping.round_robin(plan, a.max) if a.max else plan
            for r in grouping.summary_lines(plan).orderBy("part_no", "section_no").toLocalIterator():
                say(r.line)
            return 0
        texts = table(spark, a.data, "extracts").groupBy("article_no").agg(F.max("markdown").alias("markdown"))
        chapters = arts.join(texts, "article_no", "left").select(F.col("source_url").alias("url"), "title", "markdown", "word_count")
        spine = written(toc.spine(plan, chapters), "spine")
        style = a.cover_style if a.cover_style != "auto" else "editorial"
        say(epub.publish(spine, chapters, a.out, book | {"title": book["title"] or "Collected articles"}, a.theme, cover.svg(book["title"], book["author"], style=style)))
    return 0


def translated(a: argparse.Namespace, spark, say) -> int:
    """Translate through a service, or in two steps by files."""
    from pyspark.sql import functions as F

    from quire import build
    from quire.operators import chunks as C
    from quire.operators.archive import Archive
    from quire.operators.translator import ChatTranslator

    archive = Archive(a.archive)
    only = [x.strip() for x in a.only.split(",") if x.strip()] or None
    chosen = {"only": only, "skip_translated": not a.again}
    if a.export:
        C.export(build.prepared(spark, archive, **chosen)).write.mode("overwrite").text(a.export)
        say({"exported": a.export})
        return 0
    if a.import_:
        source = C.import_(spark.read.text(a.import_).withColumnRenamed("value", "json")).select("id", "text")
    elif a.endpoint:
        words = json.loads(Path(a.glossary).read_text("utf-8")) if a.glossary else {}
        source = ChatTranslator(a.endpoint, a.model, a.lang, a.key_variable, words)
    else:
        say(C.totals(build.prepared(spark, archive, **chosen)).first().asDict())
        return 0
    _, report = build.translate(spark, archive, a.dest, source, a.bilingual, a.strict, **chosen)
    say(report.agg(F.count("*").alias("articles"), F.sum("chunks").alias("chunks"), F.sum("translated").alias("translated"), F.count_if(F.size("problems") > 0).alias("with_problems")).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
