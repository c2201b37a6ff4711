import zipfile
from xml.dom import minidom

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.book import cover, epub, frontmatter, toc, typeset
from quire.operators import chunks as C
from quire.operators.archive import Archive
from quire.plans import grouping as G

PARTS = ["`c`", "$x$", "$$y\nz$$", "<b>t</b>", "[l](http://u/v)", "![i](p.png)", "[in](#x)", "https://a.b/c", "[^1]", "text", "。", "\n\n", "\n", "---", "> q", "- i", "```\ncode `x`\n```"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_protect_and_restore(parts):
    text = " ".join(parts)
    vault: list[str] = []
    p = C.protect(text, vault)
    back, bad = C.restored(p, vault)
    assert bad == [] and "".join(back.split()) == "".join(text.split())


def test_restore_is_strict():
    assert C.restore("⟦ 0 ⟧ [1] （1） ⟦7⟧", ["A", "B"]) == ("A [1] （1） ⟦7⟧", [7])


def test_blocks_sentences_pack():
    assert C.blocks("a\n\n```\nx\n\ny\n```\n\n\nb") == ["a", "```\nx\n\ny\n```", "b"]
    assert C.sentences("一。二。三。", 4) == ["一。二。", "三。"] and C.sentences("short", 9) == ["short"] and C.sentences("x" * 20, 5) == ["x" * 20]
    assert C.pack(["a" * 5, "b" * 5, "c" * 9, "d" * 12, "e"], 10) == [["a" * 5, "b" * 5], ["c" * 9], ["d" * 12], ["e"]]


def test_prepare_and_apply(spark):
    rows = [("x", "Head", "One `a`.\n\nTwo https://u/v.\n\n```\ncode\n```"), ("y", "", "Only."), ("z", None, None), ("w", "2020", "")]
    ch = C.prepare(spark.createDataFrame(rows, "id string, title string, body string"), heads=("title",), target=10)
    got = sorted((r.id, r.blocks) for r in ch.collect())
    assert [i for i, _ in got] == ["x:c0002", "x:c0003", "x:c0004", "x:fm", "y:c0001"]
    none = C.apply(ch, spark.createDataFrame([], "id string, text string"))
    a = {r.article: r for r in none.collect()}
    assert a["x"].body.split() == rows[0][2].split() and a["x"].heads == ["Head"] and a["x"].translated == 0 and len(a["x"].missing) == 4
    tr = spark.createDataFrame([("x:c0002", "EINS ⟦0⟧."), ("x:c0003", "ZWEI"), ("y:c0001", "  ")], "id string, text string")
    a = {r.article: r for r in C.apply(ch, tr, bilingual=True).collect()}
    assert "EINS `a`.\n\n> One `a`." in a["x"].body and a["x"].translated == 2 and [p.chunk for p in a["x"].problems] == ["x:c0003"] and a["y"].missing == ["y:c0001"]
    assert C.import_(C.export(ch)).count() == ch.count()
    boom = C.translate(ch, lambda t: 1 / 0)
    assert boom.where("text IS NOT NULL").count() == 0


@pytest.mark.parametrize("src,dst,n", [("a", "a", 0), ("a ⟦0⟧", "a", 1), ("a", "a ⟦3⟧", 1), ("a\n\nb", "a", 1), ("# a", "a", 1), ("x" * 200, "y" * 20, 1), ("x" * 130, "y" * 500, 1), ("word " * 50, "字" * 85, 0), ("word " * 50, "字" * 10, 1), ("x" * 100, "", 1)])
def test_check(spark, src, dst, n):
    assert len(C.check(spark.createDataFrame([(src, dst)], "src string, dst string")).first().issues) == n


def test_frontmatter():
    m = {"title": "a: b", "order": 1, "ok": True, "tags": ["x", 'q"'], "none": None, "empty": "", "list": [], "say": "yes"}
    text = frontmatter.build(m) + "# 标题\n正文"
    meta, body = frontmatter.split(text)
    assert meta == {"title": "a: b", "order": 1, "ok": True, "tags": ["x", 'q"'], "say": "yes"} and body == "# 标题\n正文"
    assert frontmatter.split("---\ntitle: x\norder: 1\n---\n# 标题\n正文") == ({"title": "x", "order": 1}, "# 标题\n正文")
    assert frontmatter.split("no block") == ({}, "no block") and frontmatter.split("---\nopen") == ({}, "---\nopen") and frontmatter.split(None) == ({}, "") and frontmatter.build({}) == ""
    assert frontmatter.simple_yaml("a: 1\nb:\n  - x\n  - 'y'\n# c\n") == {"a": "1", "b": ["x", "y"]}


def test_typeset_is_well_formed():
    md = "# A & <b>\n\np **b** *i* ~~d~~ `c<` [t](u?a=1&b) ![i](assets/x.png) <https://z>\nnext [^1]\n\n- a\n  - b\n\n1. x\n\n> q\n> r\n\n| a | b |\n| --- | --- |\n| 1 | \\| |\n\n```py\nx<1\n```\n\n---\n[^1]: note\n    more"
    x = typeset.chapter("T & t", md)
    minidom.parseString(x.encode())
    for want in ("<strong>b</strong>", "../Images/x.png", "<li>a<ul><li>b</li></ul></li>", "<th>a</th>", 'class="language-py"', 'id="fn-1"', "<ol><li>x</li></ol>"):
        assert want in x
    assert typeset.to_xhtml(None) == "" and typeset.counts(2, 3, 4567) == "2 个分类 · 3 篇 · 约 4,567 字"


def test_book(spark, tmp_path):
    e = spark.createDataFrame([("u1", "", "2020", 1), ("u2", "", "2020-02", 2), ("u3", "", "2021", 3)], "url string, title string, date string, seq long")
    plan = G.by_date(e)
    ch = spark.createDataFrame([("u1", "A", "text ![x](assets/n.png)", 5), ("u2", "B", None, None), ("u3", "C", "c", 7), ("u9", "Rest", "r", 1)], "url string, title string, markdown string, word_count int")
    sp = toc.spine(plan, ch)
    assert [(r.kind, r.title) for r in sp.orderBy("spine_no").collect()] == [("part", "2020"), ("chapter", "A"), ("chapter", "B"), ("part", "2021"), ("chapter", "C"), ("chapter", "Rest")]
    path = str(tmp_path / "b.epub")
    r = epub.publish(sp, ch, path, {"title": "T & U", "author": "A"}, cover_svg=cover.svg("T"), images={"n.png": b"x"})
    assert r["chapters"] == 4 and r["words"] == 13 and epub.validate(path) == []
    with zipfile.ZipFile(path) as z:
        assert z.namelist()[0] == "mimetype"
        for n in z.namelist():
            if n.endswith((".xhtml", ".opf", ".xml")):
                minidom.parseString(z.read(n))
    bad = str(tmp_path / "bad.epub")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    assert epub.validate(bad) == ["不是合法的 zip 文件"]
    epub.publish(sp, ch, bad, {"title": "T"})
    assert any("n.png" in p for p in epub.validate(bad))
    a = ch.withColumn("source_url", F.col("url")).withColumn("idx", F.lit(1)).withColumn("file", F.lit("f")).withColumn("published_at", F.lit("2020"))
    lines = [r.line for r in toc.index_lines(plan, a).orderBy("part_no", "section_no", "idx", "line").collect()]
    assert lines[0] == "### 2020（2 篇）" and "  1. [A](f) —— 2020 · 5 字" in lines and "### 其他（1 篇）" in lines


def test_cover():
    m = lambda s: cover.width_of(s, 10)
    rows = cover.wrap("一二三，四五六（七八九", 35, m)
    assert "".join(rows) == "一二三，四五六（七八九" and not any(r[0] in cover.NOT_FIRST for r in rows) and not any(r[-1] in cover.NOT_LAST for r in rows[:-1])
    assert cover.balance("Jane Doe 文章选读", 2, 200, m) == ["Jane Doe", "文章选读"] and cover.balance("x", 2, 99, m) is None
    assert cover.palette("x") == cover.palette("x") and abs(cover.luma("#fff") - 1) < 1e-9 and cover.luma("#000000") == 0
    for s in cover.SIZES:
        minidom.parseString(cover.svg("标题 & Title " * 9, "A", "S", s))


def test_cover_columns(spark):
    d = spark.createDataFrame([("Essays", 1, 1), ("Guide", 9, 1), ("诗", 1, 1), ("x", 9, 1), ("x", 1, 1), (None, 9, 999999)], "t string, n int, w int")
    none = F.lit("")
    assert [r.s for r in d.select(cover.recommend_style(F.col("t"), none, none, F.col("n"), F.col("w")).alias("s")).collect()] == ["editorial", "band", "minimal", "editorial", "classic", "classic"]
    assert [r.r for r in d.limit(3).select(cover.title_role(F.col("t"), F.lit("band")).alias("r")).collect()] == ["bold_en", "bold_en", "sans_zh"]


def test_archive(spark, tmp_path):
    ar = Archive(str(tmp_path / "a"), {"title": "T", "nope": 1})
    row = lambda i, t: (i, f"id{i}", t, f"content/{i}.md", "u", "", "", "", [], [], 1, False, "", "ok", "", "", "")
    from quire.operators.archive import ARTICLE

    ar.upsert_articles(spark, spark.createDataFrame([row(1, "a"), row(2, "b")], ARTICLE))
    ar.upsert_articles(spark, spark.createDataFrame([row(2, "B"), row(3, "c")], ARTICLE))
    arts = ar.table(spark, "articles")
    assert {r.id: r.title for r in arts.collect()} == {"id1": "a", "id2": "B", "id3": "c"} and ar.book == {"title": "T"}
    ar.write_content(arts.withColumn("markdown", F.lit("text")))
    (tmp_path / "a/content/old.md").write_text("x")
    assert ar.remove_orphans(spark) == 1 and ar.content_files(spark).count() == 3
    assert all("title: " in r.body and r.body.endswith("text\n") for r in ar.read_content(spark).collect())
    ar.record_stage("fetch", {"ok": 3})
    assert '"errors"' in open(ar.write_report("audit", spark.range(1).selectExpr("0 AS errors"))).read()
    plan = G.by_flat(spark.createDataFrame([("u", "", "", 1)], "url string, title string, date string, seq long"))
    assert ar.read_plan(spark) is None
    ar.write_plan(plan)
    ar.write_urls(plan)
    assert ar.read_plan(spark).count() == 1 and ar.clone_to(spark, str(tmp_path / "b")).table(spark, "articles").count() == 3


def test_prompt_and_themes(tmp_path, monkeypatch):
    got = C.prompt("⟦0⟧ text", "fr", {"a": "b"}, "about")
    assert got[1]["content"] == "⟦0⟧ text" and "a → b" in got[0]["content"] and "into fr" in got[0]["content"]
    (tmp_path / "mine.css").write_text("p{}")
    monkeypatch.setenv("QUIRE_THEMES", str(tmp_path))
    assert typeset.css("mine") == "p{}" and typeset.css("nope") == typeset.CSS["classic"]
