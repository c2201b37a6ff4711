import json

import pytest
from pyspark.sql import functions as F

from quire import build as B
from quire.operators.archive import Archive
from quire.plans import grouping as G
from quire.sources.fetch import Answer

BODY = "<article><p>" + "A sentence about kettles, and more. " * 12 + "</p><p>Second paragraph here.</p>{}</article>"


def make():
    """A transport that travels by value."""
    body = BODY

    def transport(url):
        if url.endswith("robots.txt"):
            return Answer(404)
        if url.endswith(".png"):
            return Answer(200, "", b"\x89PNG" + b"x" * 600, "image/png")
        if "bad" in url:
            return Answer(404)
        n = url.rsplit("/", 1)[-1]
        img = '<img src="/i.png" alt="p">' if n == "2" else ""
        return Answer(200, f"<html><head><title>Same title - Site</title><meta name=date content='202{int(n) % 3}-01-0{n}'></head><body>{body.format(img)}</body></html>")

    return transport


transport = make()


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(f"https://s.example/p/{i}", i) for i in (1, 2, 3)] + [("https://s.example/bad", 4), ("https://s.example/p/1#again", 5)], "url string, seq long")


def test_build_resume_reorder_translate(spark, items, tmp_path):
    root, out = str(tmp_path / "a"), str(tmp_path / "b.epub")
    opts = {"site_name": "Site", "delay": 0, "jitter": 0, "images": True}
    s = B.build(spark, items, transport, root, out, {"title": "T", "author": "A"}, **opts)
    assert (s["fetched"], s["ok"], s["failed"], s["articles_total"]) == (4, 3, 1, 3) and s["problems"] == [] and s["next_actions"]
    ar = Archive(root)
    arts = {r.source_url[-1]: r for r in ar.table(spark, "articles").collect()}
    assert {r.title for r in arts.values()} == {"Same title"} and sorted(r.id for r in arts.values()) == ["same-title", "same-title-2", "same-title-3"]
    assert arts["2"].assets == ["assets/i.png"] and (tmp_path / "a/assets/i.png").exists()
    assert "![p](assets/i.png)" in (tmp_path / "a" / arts["2"].file).read_text()
    assert json.loads((tmp_path / "a/reports/summary.json").read_text())["epub"] == out and "Same title（" not in (tmp_path / "a/index.md").read_text()
    # again: only what failed is asked for, numbers go on
    more = items.unionByName(spark.createDataFrame([("https://s.example/p/4", 6)], "url string, seq long"))
    r = B.fetch_stage(spark, ar, more, transport, **opts).first()
    assert (r.fetched, r.written, r.articles_total) == (2, 1, 4) and {x.idx for x in ar.table(spark, "articles").collect()} == {1, 2, 3, 4}
    after = B.reorder(spark, ar, "date-desc")
    order = [x.published_at for x in after.orderBy("idx").collect()]
    assert order == sorted(order, key=lambda d: d[:7], reverse=True) and ar.content_files(spark).count() == 4
    tr, report = B.translate(spark, ar, str(tmp_path / "t"), str.upper, bilingual=True)
    assert report.count() == 4 and all(x.translated and x.title == "SAME TITLE" for x in tr.table(spark, "articles").collect())
    assert "A SENTENCE" in next(iter(tr.read_content(spark).collect())).body
    (tmp_path / "a" / after.first().file).unlink()
    with pytest.raises(FileNotFoundError):
        B.reorder(spark, ar, "alpha")


def test_plan_and_nothing(spark, items, tmp_path):
    ar = Archive(str(tmp_path / "a"), {"title": "T"})
    plan = G.by_path(items.select("url", F.lit("").alias("title"), F.lit("").alias("date"), "seq"))
    B.fetch_stage(spark, ar, items.where("seq < 3"), transport, plan=plan, delay=0, jitter=0)
    assert {r.grp for r in ar.table(spark, "articles").collect()} == {"p"} and ar.read_plan(spark).count() == 3 - 1 + 1
    none = B.fetch_stage(spark, Archive(str(tmp_path / "n"), {}), items.limit(0), transport, delay=0, jitter=0).first()
    assert (none.fetched, none.written, none.articles_total) == (0, 0, 0)


def test_long_sections_are_written_in_pieces(spark, tmp_path):
    row = "part_no long, part_title string, part_slug string, section_no long, section_title string, section_slug string, pos long, url string"
    plan = spark.createDataFrame([(1, "P", "p", 1, "S", "s", i, f"u{i}") for i in range(1, 8)], row)
    ar = Archive(str(tmp_path / "a"))
    ar.write_plan(plan)
    lines = [json.loads(x) for f in sorted((tmp_path / "a/metadata/groups").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["subgroups"][0]["urls"] for x in lines] == [[f"u{i}" for i in range(1, 8)]] and ar.read_plan(spark).count() == 7
    got = G.pieces(plan, 3).orderBy("start").collect()
    assert [(r.start, r.subgroups[0].urls) for r in got] == [(1, ["u1", "u2", "u3"]), (4, ["u4", "u5", "u6"]), (7, ["u7"])]


def test_strict_translation_keeps_the_texts_of_untranslated_articles(spark, items, tmp_path):
    ar = Archive(str(tmp_path / "a"), {"title": "T"})
    B.fetch_stage(spark, ar, items.where("seq < 4"), transport, delay=0, jitter=0, images=True)
    before = {r.id: r.body for r in ar.read_content(spark).collect()}
    assert all(len(b) > 300 for b in before.values())
    # a translator that loses marks and paragraphs has problems everywhere
    tr, report = B.translate(spark, ar, str(tmp_path / "t"), lambda t: "x", strict=True)
    assert report.where("size(problems) > 0").count() == 3
    assert {r.id: r.body for r in tr.read_content(spark).collect()} == before
    assert (tmp_path / "t/assets/i.png").read_bytes() == (tmp_path / "a/assets/i.png").read_bytes() and (tmp_path / "t/reports/quality-report.json").exists()
    assert tr.book["source_archive"] == str(tmp_path / "a") and tr.book["title"] == "T"


def test_copied_names_are_taken_as_they_are(spark, tmp_path):
    ar = Archive(str(tmp_path / "a"))
    for n in ("a b.md", "50%25+x.md", "ü.md"):
        (tmp_path / "a/content").mkdir(exist_ok=True)
        (tmp_path / "a/content" / n).write_text(n)
    ar.copy_files(spark, "content", tmp_path / "c")
    assert sorted(p.name for p in (tmp_path / "c/content").iterdir()) == sorted(("a b.md", "50%25+x.md", "ü.md"))
    assert ar.remove_orphans(spark) == 3 and not list((tmp_path / "a/content").iterdir())
