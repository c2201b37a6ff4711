"""Commands, gathered items, images and the translator, over a transport without a network."""

import json
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import build as B
from quire.__main__ import doctor, main
from quire.functions import url as U
from quire.operators.archive import Archive
from quire.operators.translator import ChatTranslator
from quire.plans import grouping as G
from quire.sources import fetch as FE
from quire.sources import items as IT


def make():
    """A site with links, an index of sitemaps, a feed and a REST interface, as a function that travels by value."""
    import json as j

    from quire.sources.fetch import Answer

    text = "A sentence about kettles, and more. " * 14

    def page(n):
        return f"<html><head><title>Story {n}</title><meta name=date content='2021-0{n}-01'></head><body><article><h1>Story {n}</h1><p>{text}</p><img src='img/{n}.png' alt='i'></article></body></html>"

    cats = [{"id": 1, "slug": "one", "name": "One", "parent": 0, "count": 2, "description": ""}, {"id": 2, "slug": "two", "name": "Two", "parent": 0, "count": 1, "description": ""}]
    posts = [{"id": n, "link": f"https://w.example/p/{n}", "date": f"2021-0{n}-01", "title": {"rendered": f"Story {n}"}, "categories": [1 + n % 2], "tags": []} for n in (1, 2, 3)]

    def transport(url):
        path = url.split("://")[1].partition("/")[2]
        if path.startswith("p/") and path.count("/") == 1:
            return Answer(200, page(path[2:]))
        if url.endswith(".png"):
            return Answer(200, "", b"\x89PNG" + url.encode() * 60, "image/png")
        if url.startswith("https://w.example/wp-json/wp/v2/categories"):
            return Answer(200, j.dumps(cats))
        if url.startswith("https://w.example/wp-json/wp/v2/posts"):
            return Answer(200, j.dumps(posts if "per_page=100" in url else posts[:1]))
        if url == "https://w.example/wp-json/":
            return Answer(200, j.dumps({"name": "Wide", "namespaces": ["wp/v2"]}))
        known = {
            "https://s.example/": "<title>Site | Home</title><body><a href='/p/1'>A long enough title of one</a><a href='/p/2'>Another rather long title</a><a href='/x.css'>no</a></body>",
            "https://s.example/one": "<p>an article <a href='/p/3'>only link</a></p>", "https://w.example/": "<title>Wide</title>",
            "https://s.example/sitemap.xml": "<sitemapindex><sitemap><loc>https://s.example/m1.xml</loc></sitemap><sitemap><loc>https://s.example/sitemap.xml</loc></sitemap></sitemapindex>",
            "https://s.example/m1.xml": "<urlset><url><loc>https://s.example/p/2</loc></url><url><loc>https://s.example/p/4</loc></url></urlset>",
            "https://s.example/feed": "<rss><channel><link>https://s.example/p/5</link></channel></rss>",
        }
        return Answer(200, known[url]) if url in known else Answer(404)

    return transport


transport = make()
FAST = {"delay": 0, "jitter": 0}


def test_items_of_all_sources(spark, tmp_path):
    f = tmp_path / "u.txt"
    f.write_text("# list\nhttps://s.example/p/9\n\n https://s.example/p/1 \n")
    got = IT.gather(spark, transport, str(f), ["https://s.example/sitemap.xml"], ["https://s.example/feed"], ["https://s.example/", "https://s.example/one", "https://s.example/gone"], **FAST).orderBy("seq").collect()
    assert [(r.url[-3:], r.section) for r in got[:5]] == [("p/9", "urls-file"), ("p/1", "urls-file"), ("p/2", "sitemap"), ("p/4", "sitemap"), ("p/5", "feed")]
    assert [(r.url, r.section) for r in got[5:]] == [("https://s.example/one", "single")]
    # entries are what they are
    got = IT.gather(spark, transport, entries=["https://s.example/sitemap.xml", "https://s.example/feed", "https://s.example/"], limit=4, **FAST).orderBy("seq").collect()
    assert [(r.url[-3:], r.section) for r in got] == [("p/2", "sitemap"), ("p/4", "sitemap"), ("p/5", "feed"), ("p/1", "https://s.example/")]
    assert IT.gather(spark, transport).count() == 0


def test_site_with_an_interface(spark, tmp_path):
    s = B.build_site(spark, "https://w.example/", transport, str(tmp_path / "a"), str(tmp_path / "b.epub"), {"author": "A"}, images=True, **FAST)
    assert s["articles_total"] == 3 and s["problems"] == []
    ar = Archive(str(tmp_path / "a"))
    rows = {r.source_url[-1]: r for r in ar.table(spark, "articles").collect()}
    assert {k: r.grp for k, r in rows.items()} == {"1": "Two", "2": "One", "3": "Two"} and ar.book["title"] == "Wide"
    # in the order of the plan, images joined to the page and reported
    assert [r.source_url[-1] for r in sorted(rows.values(), key=lambda r: r.idx)] == ["2", "1", "3"]
    assert rows["1"].assets == ["assets/1.png"]
    assert json.loads((tmp_path / "a/reports/images.json").read_text()) == {"images": 3, "stored": 3, "deduplicated": 0, "failed": 0, "shrunk": 0, "saved_bytes": 0}
    with zipfile.ZipFile(tmp_path / "b.epub") as z:
        names = z.namelist()
        assert "OEBPS/Images/1.png" in names
        part = next(n for n in names if "part0" in n)
        assert "第一部" in z.read(part).decode() and "1 篇" in z.read(part).decode()


def test_fetch_pack_group_cover_translate(spark, tmp_path, capsys):
    a, t = str(tmp_path / "a"), str(tmp_path / "t")
    assert main(["--json", "fetch", a, "--entry", "https://s.example/", "--max", "2", "--delay", "0", "--title", "Book", "--author", "Jo"], transport) == 0
    assert json.loads(capsys.readouterr().out)["written"] == 2
    assert main(["group", a, "--by", "date"]) == 0 and "2021" in capsys.readouterr().out
    assert main(["--json", "pack", a, "-o", str(tmp_path / "b.epub"), "--by", "flat"]) == 0 and json.loads(capsys.readouterr().out)["chapters"] == 2
    assert main(["--json", "cover", "-o", str(tmp_path / "c.svg"), "--archive", a, "--subtitle", "Sub"]) == 0
    svg = (tmp_path / "c.svg").read_text()
    assert "Book" in svg and "Sub" in svg and json.loads(capsys.readouterr().out)["style"] == "classic"
    assert main(["--json", "translate", a, t]) == 0 and json.loads(capsys.readouterr().out)["chunks"] == 4
    assert main(["translate", a, t, "--export", str(tmp_path / "x")]) == 0
    one = Archive(a).table(spark, "articles").orderBy("idx").first()
    rows = spark.read.text(str(tmp_path / "x")).collect()
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "z.json").write_text("\n".join(r.value.replace("kettles", "KESSEL") for r in rows))
    capsys.readouterr()
    assert main(["--json", "translate", a, t, "--import", str(tmp_path / "y"), "--only", one.id]) == 0
    assert json.loads(capsys.readouterr().out) == {"articles": 1, "chunks": 2, "translated": 2, "with_problems": 0}
    done = {r.id: r for r in Archive(t).read_content(spark).collect()}
    assert "KESSEL" in done[one.id].body and done[one.id].translated and sum("KESSEL" in r.body for r in done.values()) == 1 and all(r.body for r in done.values())


def test_looking_around(capsys, tmp_path):
    assert main(["--json", "doctor"]) == 0
    found = {r["what"]: r for r in json.loads(capsys.readouterr().out)}
    assert found["pyspark"]["found"] and not found["yaml"]["needed"] and doctor([])[0]["what"] == "python"
    (tmp_path / "a.json").write_text('{"name": "mine", "hosts": ["m.example"]}')
    assert main(["--json", "adapters", "--adapters", str(tmp_path)]) == 0
    assert "mine" in [r["name"] for r in json.loads(capsys.readouterr().out)]
    assert main(["adapters", "--adapters", str(tmp_path), "--match", "https://m.example/1"]) == 0 and capsys.readouterr().out.strip() == "mine"
    assert main(["adapters", "--match", "https://none.example/"]) == 1
    assert main(["--json", "info", "https://w.example/"], transport) == 0 and '"wordpress"' in capsys.readouterr().out


def test_relative_images(spark):
    md, base = F.lit('![a](../i/1.png) ![b](https://x.example/2.png) <img src="/3.gif"> ![d](data:x)'), F.lit("https://s.example/a/b/c")
    assert spark.range(1).select(U.image_urls(md, base)).first()[0] == ["https://s.example/a/i/1.png", "https://x.example/2.png", "https://s.example/3.gif"]
    assert spark.range(1).select(U.image_urls(F.lit(None).cast("string"), base)).first()[0] == []


def test_images_shrink_only_where_it_saves(spark):
    df = spark.createDataFrame([("https://x/a.png", True, b"no image", "image/png"), ("https://x/b", True, None, None)], "url string, ok boolean, content binary, content_type string")
    got = {r.url: r for r in FE.shrunk(df, 100).collect()}
    assert bytes(got["https://x/a.png"].content) == b"no image" and got["https://x/a.png"].saved == 0 and got["https://x/b"].content is None
    stored = spark.createDataFrame([("u1", None, "a.png"), ("u2", None, "a.png"), ("u3", "robots", None)], "url string, problem string, name string")
    assert FE.image_stats(df, stored).first().asDict() == {"images": 3, "stored": 1, "deduplicated": 1, "failed": 1, "shrunk": 0, "saved_bytes": 0}


def test_items_in_the_order_of_the_plan(spark):
    plan = G.by_flat(spark.createDataFrame([("https://x/b", "2020", 1), ("https://x/a", "2021", 2)], "url string, date string, seq long"))
    items = spark.createDataFrame([("https://x/z", 1), ("https://x/a#f", 2), ("https://x/b", 3)], "url string, seq long")
    assert [r.url[-1] if r.url[-1] != "f" else "a" for r in G.ranked(items, plan).orderBy("seq").collect()] == ["b", "a", "z"]


def test_translator_tries_again(monkeypatch):
    asked, waits = [], []

    def send(request, timeout):
        asked.append(json.loads(request.data))
        if len(asked) == 1:
            raise urllib.error.HTTPError("u", 503, "busy", None, None)
        if len(asked) == 2:
            return b"not json"
        assert request.get_header("Authorization") == "Bearer k"
        return json.dumps({"choices": [{"message": {"content": " fertig "}}]}).encode()

    monkeypatch.setenv("QUIRE_TRANSLATOR_KEY", "k")
    t = ChatTranslator("https://t.example/v1", "m", glossary={"a": "b"}, send=send, sleep=waits.append)
    assert t("text ⟦0⟧") == "fertig" and waits == [2.0, 4.0] and asked[0]["model"] == "m" and "a → b" in asked[0]["messages"][0]["content"]

    def never(request, timeout):
        raise urllib.error.HTTPError("u", 401, "no", None, None)

    with pytest.raises(urllib.error.HTTPError):
        ChatTranslator("https://t.example/v1", "m", send=never, sleep=waits.append)("x")


def test_volumes(spark, tmp_path):
    from quire.book import epub, toc

    e = spark.createDataFrame([(f"u{i}", f"20{10 + i // 4}", i) for i in range(10)], "url string, date string, seq long")
    plan = G.by_date(e.withColumn("title", F.lit("")))
    ch = e.select("url", F.col("url").alias("title"), F.lit("text ![x](assets/n.png)").alias("markdown"), F.lit(7).alias("word_count"))
    (tmp_path / "n.png").write_bytes(b"png")
    r = epub.publish(toc.spine(plan, ch), ch, str(tmp_path / "b.epub"), {"title": "T"}, images={"n.png": tmp_path / "n.png", "spare.png": b"s"}, most=4)
    assert r["chapters"] == 10 and r["words"] == 70 and [p[-8:] for p in r["volumes"]] == ["/b.epub", "b-2.epub", "b-3.epub"] or [p.rsplit("/", 1)[-1] for p in r["volumes"]] == ["b.epub", "b-2.epub", "b-3.epub"]
    seen = []
    for p in r["volumes"]:
        assert epub.validate(p) == []
        with zipfile.ZipFile(p) as z:
            names = z.namelist()
            assert "OEBPS/Images/n.png" in names and any("part" in n for n in names)
            seen += [n for n in names if "chap" in n]
    assert len(seen) == len(set(seen)) == 10


def test_titles_of_addresses_and_headings(spark):
    from quire.functions import text as T

    urls = ["https://a.b/one-two_three.html", "https://a.b/", "https://a.b/x/it's-4th", None, ""]
    got = [r.t for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(U.title_of_url(F.col("u")).alias("t")).collect()]
    assert got == ["One Two Three", "A.B", "It'S 4Th", "", ""]
    h = spark.createDataFrame([(1, "<p>x</p><H1 class=a> A <b>b</b>\n</H1><h1>no</h1>"), (2, None), (3, "none")], "i int, h string").orderBy("i").select(T.first_heading(F.col("h")).alias("t")).collect()
    assert [r.t for r in h] == ["A b", "", ""]


def test_stats_assets_and_paths(spark, tmp_path):
    from quire.operators.archive import relative

    ar = Archive(str(tmp_path / "a"))
    ar.set_stats(words=3)
    ar.set_stats(articles=1)
    assert ar.stats == {"words": 3, "articles": 1}
    kind = "path string, size long, kind string, source_url string"
    ar.add_assets(spark, spark.createDataFrame([("assets/a", 5, "image", "u1"), ("assets/b", 7, "image", "u2")], kind))
    ar.add_assets(spark, spark.createDataFrame([("assets/a", 0, "other", "u9"), ("assets/b", 9, "other", "u9"), ("assets/c", 1, "image", "u3")], kind))
    got = {r.path: (r.size, r.kind, r.source_url) for r in ar.table(spark, "assets").collect()}
    assert got == {"assets/a": (5, "image", "u1"), "assets/b": (9, "image", "u2"), "assets/c": (1, "image", "u3")}
    assert relative(tmp_path / "a/x/y", tmp_path / "a") == "x/y" and relative("/elsewhere", tmp_path) == "/elsewhere"


def test_headed_blog():
    from quire.operators import extract as X
    from quire.sources.adapters import headed_blog

    body = "<p>正文第一段，讲的是水壶的故事。</p>" * 20
    page = f"<html><header class='article-header'><h1>题目</h1><ul class='article-meta'><li>阿吉 发布于 2020-3-4</li><li>阅读 9</li></ul></header><article class='article-content'>{body}<h2>小节</h2><div class='post-copyright'>转载</div></article></html>"
    a = headed_blog(["b.example"])
    got = X.extract_page(page, "https://b.example/1", a)
    assert (got["title"], got["author"], got["published_at"]) == ("题目", "阿吉", "2020-3-4") and "### 小节" in got["markdown"] and "转载" not in got["markdown"]
    locked = X.extract_page("<article class='article-content'><form class='post-password-form'><input></form></article>", "https://b.example/2", a)
    assert "受密码保护" in locked["markdown"] and a.entry_urls("https://b.example/") == ["https://b.example/wp-sitemap-posts-post-1.xml"]


def test_colours():
    import numpy as np

    from quire.book import cover as C

    assert C.rgb("#fff") == (255, 255, 255) and C.rgb("0d1b2a") == (13, 27, 42)
    assert abs(C.luma("#fff") - 1) < 1e-9 and C.luma("#000000") == 0
    img = np.zeros((10, 10, 3), np.uint8)
    img[:, 5:] = 255
    assert C.region_luma(img, (5, 0, 99, 10)) == 255 and C.region_luma(img, (0, 0, 10, 10)) == 127.5 and C.region_luma(img, (3, 3, 3, 3)) == 128
    assert C.text_color(img, (0, 0, 5, 10)) == C.ON_DARK and C.text_color(img, (5, 0, 10, 10)) == C.ON_LIGHT
