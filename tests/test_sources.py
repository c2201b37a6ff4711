import pytest
from pyspark.sql import functions as F

from quire.sources import adapters as AD
from quire.sources import discover as D
from quire.sources import fetch as FE


def test_links(spark):
    html = "<a href='/2020/01/x-y'>A long enough title here yes</a><a href='/2020/01/x-y#f'>again</a><a href='http://c.d/p/1'>o</a><a href='/tag/q'>t</a><nav><a href=/z>z</a></nav><a href='/p/2'>two</a><a href='mailto:x'>m</a><a href='/'>self</a>"
    a = D.anchors(spark.createDataFrame([("http://a.b/", html), ("http://n.o/", None)], "url string, html string"))
    got = {r.url: r.score for r in D.links(a).collect()}
    assert got == {"http://a.b/2020/01/x-y": 6, "http://a.b/p/2": 3}
    assert {r.url for r in D.links(a, same_host=False, exclude="/p/2").collect()} == {"http://a.b/2020/01/x-y", "http://c.d/p/1"}
    assert D.links(a, min_hint=6).count() == 2 and D.links(a, limit=1).first().url.endswith("x-y") and D.links(a, include="P/2").count() == 1


def test_sitemap_with_a_loop(spark):
    b = spark.createDataFrame([("s", "<sitemapindex><loc>s1</loc><loc>s2</loc><loc>s</loc>"), ("s1", "<urlset><loc> http://x/1 </loc><LOC>http://x/2</LOC>"), ("s2", "<sitemapindex><loc>s1</loc><loc>s3</loc>"), ("s3", "<urlset><loc>http://x/3</loc>")], "url string, body string")
    assert [r.url for r in D.from_sitemap(b, "s").orderBy("level", "sitemap", "pos").collect()] == ["http://x/1", "http://x/2", "http://x/3"]
    assert [r.url for r in D.from_sitemap(b, "s", include="[23]$", limit=1).collect()] == ["http://x/2"] and D.from_sitemap(b, "none").count() == 0


def test_feed_and_sniffing(spark):
    body = "<rss><link>http://a/1</link><link href='http://a/2'/><link href='/rel'/><guid>http://a/1</guid><guid isPermaLink='true'>http://a/3</guid>"
    df = spark.createDataFrame([("f", body), ("g", None)], "url string, body string")
    assert [r.url for r in D.from_feed(df).orderBy("pos").collect()] == ["http://a/1", "http://a/2", "http://a/3"] and D.from_feed(df, 2).count() == 2
    r = df.select(D.is_feed(F.col("body")).alias("f"), D.is_sitemap(F.col("body")).alias("s")).collect()
    assert (r[0].f, r[0].s, r[1].f) == (True, False, False)


def test_urls_file_and_resolve(spark, tmp_path):
    p = tmp_path / "u.txt"
    p.write_text("# c\nhttp://a/1\n\n http://a/2 \nftp://no\n")
    f = D.from_urls_file(spark, str(p))
    assert [r.url for r in f.orderBy("seq").collect()] == ["http://a/1", "http://a/2", "ftp://no"]
    more = spark.createDataFrame([("http://a/2#x", "feed", 0), ("http://a/3", "feed", 1)], "url string, section string, seq long")
    got = D.resolve(f.withColumn("section", F.lit("file")), more).orderBy("seq").collect()
    assert [(r.url, r.section) for r in got] == [("http://a/1", "file"), ("http://a/2", "file"), ("http://a/3", "feed")]
    assert D.resolve(more, limit=1).count() == 1


def test_rest_paging_and_rows(spark):
    asked = []

    def get(u):
        asked.append(u)
        n = int(u.split("page=")[2].split("&")[0])
        return "[" + ",".join(f'{{"id": {n * 10 + i}, "slug": "s", "zzz": 1}}' for i in range(2 if n < 3 else 1)) + "]"

    pages = D.rest_pages(get, "https://w.p/blog", "categories", "id,slug", per_page=2)
    assert len(pages) == 3 and asked[0].startswith("https://w.p/wp-json/wp/v2/categories?") and D.rest_pages(lambda u: "{bad", "w.p", "posts", "id") == []
    df = spark.createDataFrame([(p,) for p in [*pages, "{}", None]], "body string")
    assert D.rest_rows(df, D.CATEGORY).count() == 5


def test_detect(spark):
    p = spark.createDataFrame([("1", "a", "x", "", ""), ("2", "", "x", "f", ""), ("3", None, "", "f", "s"), ("4", "", "", "", "s"), ("5", "", "", None, "")], "url string, adapter string, api string, feed string, sitemap string")
    assert [r.kind for r in D.detect(p).orderBy("url").collect()] == ["adapter", "wordpress", "feed", "sitemap", "list"]
    r = spark.range(1).select(D.is_wordpress(F.lit('{"namespaces": ["wp/v2"]}'), F.lit("[]")).alias("a"), D.is_wordpress(F.lit("x"), F.lit("[]")).alias("b"), D.feed_candidates(F.lit('<link rel=alternate type="application/rss+xml" href="/my.xml">'), F.lit("http://a.b/c")).alias("c"), D.sitemap_candidates(F.lit("Sitemap: http://a.b/s.xml\nsitemap: http://a.b/z.gz"), F.lit("http://a.b/c")).alias("d")).first()
    assert r.a and not r.b and r.c[:2] == ["http://a.b/my.xml", "http://a.b/feed"] and r.d[:2] == ["http://a.b/s.xml", "http://a.b/sitemap.xml"]


def script(*answers):
    it = iter(answers)

    def t(u):
        a = next(it)
        if isinstance(a, Exception):
            raise a
        return a

    return t


@pytest.mark.parametrize("answers,ok,status,attempts,waits", [
    ([FE.Answer(200, "x")], True, 200, 1, []), ([FE.Answer(404)], False, 404, 1, []), ([FE.Answer(500), FE.Answer(200)], True, 200, 2, [1]),
    ([FE.Answer(429, retry_after="7"), FE.Answer(503), FE.Answer(200)], True, 200, 3, [7, 4]), ([FE.Answer(429, retry_after="999")] * 3, False, 0, 3, [60, 60, 60]),
    ([OSError("gone")] * 3, False, 0, 3, [1, 2]), ([FE.Answer(451)], False, 451, 1, []),
])
def test_retries(answers, ok, status, attempts, waits):
    slept = []
    r = FE.fetch_one("http://h/1", script(*answers), FE.Pace(0, 0), None, 2, slept.append)
    assert (r["ok"], r["status"], r["attempts"]) == (ok, status, attempts) and [int(w) for w in slept] == waits


def test_pace_and_robots():
    now, slept = [0.0], []
    p = FE.Pace(1.0, 0.0, lambda: now[0], slept.append)
    for u in ("http://a/1", "http://a/2", "http://b/1", "http://a/3"):
        p.wait(u)
    assert slept == [1.0, 2.0]
    calls = []

    def t(u):
        calls.append(u)
        return FE.Answer(200, "User-agent: *\nDisallow: /no") if "a" in u.split("/")[2] else FE.Answer(500)

    r = FE.Robots(t)
    assert r.allows("http://a/x") and not r.allows("http://a/no/1") and r.allows("http://b/no") and len(calls) == 2


def test_fetch_with_cache(spark):
    def t(u):
        return FE.Answer(200, "User-agent: *\nDisallow: /no") if u.endswith("robots.txt") else FE.Answer(200, "hi " + u)

    items = spark.createDataFrame([("http://h/1",), ("http://h/1",), ("http://h/no",), ("http://k/2",), (None,)], "url string")
    first = FE.fetch(items, t, delay=0, jitter=0)
    got = {r.url: r for r in first.collect()}
    assert set(got) == {"http://h/1", "http://h/no", "http://k/2"} and "robots" in got["http://h/no"].error
    cache = spark.createDataFrame([r for r in got.values()], first.schema)
    again = {r.url: r.from_cache for r in FE.fetch(items, t, cache, delay=0, jitter=0).collect()}
    assert again == {"http://h/1": True, "http://h/no": False, "http://k/2": True}


def test_images(spark):
    im = spark.createDataFrame(
        [("http://x/a.png", True, 200, "", b"x" * 600, "image/png", 1), ("http://x/b/A.png", True, 200, "", b"y" * 600, "", 2), ("http://x/c.gif", True, 200, "", b"x" * 600, "image/gif", 3), ("http://x/d", False, 0, "robots.txt no", None, "", 4),
         ("http://x/e", False, 404, "", None, "", 5), ("http://x/f.svg", True, 200, "", b"<svg/>", "image/svg+xml; x", 6), ("http://x/g.png", True, 200, "", b"s", "image/png", 7), ("http://x/", True, 200, "", b"z" * 600, "", 8)],
        "url string, ok boolean, status int, error string, content binary, content_type string, seq int",
    )
    got = {r.url: r.name or r.problem for r in FE.stored_images(im).collect()}
    assert got["http://x/a.png"] == got["http://x/c.gif"] == "a.png" and got["http://x/b/A.png"] == "a-2.png" and got["http://x/d"] == "robots" and got["http://x/e"] == "http-404"
    assert got["http://x/f.svg"] == "f.svg" and got["http://x/g.png"] == "too_small" and got["http://x/"].startswith("img-")
    texts = spark.createDataFrame([(1, "a %%P1%% b %%P2%%"), (2, "none")], "id int, markdown string")
    refs = spark.createDataFrame([(1, "%%P1%%", "http://x/a.png"), (1, "%%P2%%", "http://x/e")], "id int, placeholder string, url string")
    assert {r.id: r.markdown for r in FE.rewrite_images(texts, refs, FE.stored_images(im)).collect()} == {1: "a assets/a.png b http://x/e", 2: "none"}


def test_adapter_join(spark):
    a = [AD.ConfigAdapter.of(c) for c in ({"name": "r", "match_regex": r"/p/\d"}, {"name": "h", "hosts": ["Foo.com"]}, {"name": "x", "url_prefixes": ["https://"]})]
    urls = ["http://www.foo.com/p/1", "http://foo.com/", "https://z/", "http://xfoo.com/", None]
    got = {r.url: r.adapter for r in AD.match_urls(spark.createDataFrame([(u,) for u in urls], "url string"), AD.adapter_rows(spark, a)).collect()}
    assert got == {urls[0]: "r", urls[1]: "h", urls[2]: "x", urls[3]: None, None: None}


SITE = {"https://a.b/": "<html lang=zh-Hans><title>Name | Home</title><meta name=author content=Jo><link rel=alternate type='application/rss+xml' href='/f.xml'>"}
API = {"https://a.b/wp-json/": '{"name": "N", "namespaces": ["wp/v2"]}', "https://a.b/wp-json/wp/v2/posts?per_page=1&_fields=id": '[{"id": 1}]'}


@pytest.mark.parametrize("more,kind", [
    (API, "wordpress"), ({"https://a.b/f.xml": "<rss>"}, "feed"), ({"https://a.b/atom.xml": "<?xml ?><channel>"}, "feed"), ({"https://a.b/robots.txt": "Sitemap: https://a.b/m.xml.gz\nSitemap: https://a.b/m.xml", "https://a.b/m.xml": "<urlset>"}, "sitemap"), ({}, "list"),
])
def test_probe(more, kind):
    from quire.sources.probe import probe

    pages = SITE | more
    p = probe(lambda u: pages[u], "https://a.b/")
    assert (p.kind, p.title, p.author, p.language) == (kind, "Name", "Jo", "zh-CN") and bool(p.notes) == (kind != "wordpress")
    reg = AD.Registry([AD.ConfigAdapter.of({"name": "x", "hosts": ["a.b"], "entry_urls": ["/list"]})])
    q = probe(pages.get, "https://a.b/", reg)
    assert (q.kind, q.adapter, q.entry_urls, bool(q.api_root)) == ("adapter", "x", ["https://a.b/list"], kind == "wordpress")


def test_images_stay_without_a_reader():
    assert FE.shrink_image(b"no image", ".png", 100) == (b"no image", ".png") and FE.shrink_image(b"<svg/>", ".svg", 9) == (b"<svg/>", ".svg")
