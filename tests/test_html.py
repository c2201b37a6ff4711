import pytest
from pyspark.sql import functions as F

from quire.html import meta as HM
from quire.html import select as S
from quire.html.dom import parse
from quire.html.markdown import Writer
from quire.html.xpath import select
from quire.operators import extract as X
from quire.sources.adapters import ConfigAdapter, Registry, load, table_essays


def md(html, base="https://x.y/p/", **kw):
    return Writer(base, **kw).write(parse(html))


@pytest.mark.parametrize("html,want", [
    ("<h3>A <b>b</b></h3>", "### A **b**\n"), ("<p>a<br><br>b<p>c", "a\n\nb\n\nc\n"), ("<p>a<br>b</p>", "a b\n"), ("a<hr>b", "a\n\n---\n\nb\n"),
    ("<p><em>i</em> <del>d</del> <code>x`y</code></p>", "*i* ~~d~~ ``x`y``\n"), ('<pre class="lang-py">a\n```\n</pre>', "````python\na\n```\n````\n"),
    ("<blockquote>q</blockquote>", "> q\n"), ("<ol start=3><li>a<li value=7>b</ol>", "3. a\n4. b\n"), ("<ul><li>a<li></ul>", "- a\n-\n"),
    ('<a href="/q">t</a>', "[t](https://x.y/q)\n"), ('<a href="https://z.w">https://z.w/</a>', "<https://z.w>\n"), ('<a href="javascript:x">t</a>', "t\n"),
    ('<img data-src="i.png" alt="A">', "![A](https://x.y/p/i.png)\n"), ('<img src="data:x">', "\n"), ('<img src="file:///c">', "\n"),
    ("<figure><img src=/i.png><figcaption>c</figcaption></figure>", "![](https://x.y/i.png)\n\n*c*\n"),
    ("<table><tr><td>a<td>b|c<tr><td>d</table>", "| a | b\\|c |\n| --- | --- |\n| d |  |\n"), ("<table><tr><td>one</table>", "one\n"), ("<table>bare</table>", "bare\n"),
    ("<dl><dt>T<dd>D</dl>", "**T**\n: D\n"), ("<details><summary>S</summary>x</details>", "**S**\nS\n\nx\n"), ("<video src=/v></video>", "[video: https://x.y/v]\n"),
    ("<script>1</script><nav>n</nav>x", "x\n"), ("<p>a<b>b<p>c", "a**b**\n\nc\n"),
])
def test_markdown_goldens(html, want):
    assert md(html) == want


def test_task_boxes_and_images_with_resolver():
    w = Writer("", lambda s, a, n: f"assets/{s}" if s != "b" else None)
    assert w.write(parse("<ul><li><input type=checkbox checked> a</ul><img src=a><img src=b>")) == "- [x] a\n\n![](assets/a)\n\n![](b)\n" and w.images == ["assets/a"]


@pytest.mark.parametrize("bad", ["<![foo[x]]>", "<![ x]>", "<![>", "<![1]>", "<![foo\n[x]]>", "<![endif foo>", "<![if x>", "<![CDATA[x>"])
def test_malformed_marked_sections_are_comments(bad):
    r = parse(f"<p>a</p>{bad}<p>b</p>{bad}<p>c</p>")
    assert [p.text() for p in r.find("p")] == ["a", "b", "c"] and "<!" not in r.text()
    assert md(f"<article><p>a</p>{bad}<p>b</p></article>") == "a\n\nb\n"


def test_marked_sections_lose_no_text():
    assert [p.text() for p in parse("<p>a</p><![if x><p>b</p><![endif]><p>c</p>").find("p")] == ["a", "b", "c"]
    assert parse("<p>a<![CDATA[<b>b</b>]]>c</p>").text() == "ab]]>c" and parse("<p>a<svg><![CDATA[x>y]]></svg>c</p>").text() == "ac"


def test_character_references_of_any_length():
    assert parse("<p>a&#" + "9" * 5000 + ";</p><p>b</p>").text() == "a\ufffdb"
    assert parse("<p title='&#" + "0" * 5000 + "65;'>a&#" + "0" * 5000 + "66;&#000000067;&#0000000000;&#68;</p>").text() == "aBC\ufffdD"


def test_tree_recovers():
    r = parse("<table><tr><td>a<td>b<tr><td>c</table><p>x<div>y</div><script>var a='</p>'</script>")
    assert len(list(r.find("tr"))) == 2 and [p.text() for p in r.find("p")] == ["x"]
    for bad in (None, "", "<", "<!", "<![x", "&#xffffffff;", "<p" * 50, "</div>" * 50, "<div>" * 3000):
        parse(bad).text()


def test_xpath_subset():
    r = parse('<div class="a b"><p id=x>1</p><p>2</p></div><p>3</p>')
    assert [n.text() for n in select(r, "//div[contains(@class,'b')]/p")] == ["1", "2"] and [n.text() for n in select(r, "//p[@id='x'] | //p[2]")] == ["1", "2"]
    assert select(r, "//p[text()='1']") == [] and select(r, "") == [] and select(r, "div[[") == []


def page(body, head=""):
    return f"<html lang=en><head>{head}</head><body>{body}</body></html>"


LONG = "<p>" + "A sentence about kettles, and more. " * 20 + "</p>"


def test_content_and_confidence():
    for html, strategy, sure in [
        (page(f"<article>{LONG * 5}</article>"), "article-tag", 0.96), (page(f"<main>{LONG}</main>"), "main-tag", 0.595), (page(f'<div class="post-content">{LONG * 2}</div>'), "class:post-content", 0.9),
        (page(f"<div>{LONG * 2}</div>"), "heuristic", 0.62), (page("short"), "body-fallback", 0.108),
    ]:
        root = parse(html)
        S.prune(root)
        _, c, s = S.find_content(root)
        assert (s, c) == (strategy, sure)


def test_prune_keeps_tails_and_drops_link_lists():
    r = parse(page("<div id=sidebar>s</div>tail<ul>" + "<li><a href=#>some link text here</a>" * 9 + "</ul><div>" + LONG + "</div>"))
    S.prune(r)
    t = r.text()
    assert "tail" in t and "some link" not in t and "kettles" in t


def test_meta_order():
    head = '<title>Post - Site</title><meta property="og:site_name" content="Site"><meta name="twitter:title" content="Tw"><meta name=author content=" "><meta name="dc.creator" content="Dc">'
    m = HM.page_meta(parse(page("", head)), "https://h.i/x")
    assert (m["title"], m["author"], m["language"]) == ("Tw", "Dc", "en")
    ld = '<script type="application/ld+json">[{"@type":["X","NewsArticle"],"headline":"LD","author":[{"name":"N"}],"datePublished":"2020"}]</script>'
    m = HM.page_meta(parse(page("", head + ld)))
    assert (m["title"], m["author"], m["published_at"]) == ("LD", "N", "2020")
    assert HM.page_meta(parse(page("", '<script type="application/ld+json">{bad</script>')), "https://h.i/x") == {"language": "en", "site_name": "h.i"}


def test_decode():
    assert HM.decode('<meta charset="gbk">中'.encode("gbk")).endswith("中") and HM.decode("é".encode()) == "é" and HM.decode(b"\xff\xe9") and HM.decode(None) == ""


def test_breaks_become_paragraphs():
    r = parse(page("<div>" + "text here<br><br>" * 8 + "</div>"))
    S.split_breaks(r)
    assert len(list(r.find("p"))) == 8


def test_adapters(tmp_path):
    a = ConfigAdapter.of({"name": "foo", "hosts": ["foo.com"], "link_include": "^/post/", "link_exclude": "/tag/", "content_xpath": "//div[@id='c']", "remove": ["//p[@class='x']"], "title_selector": "//h1", "date_selector": "//time", "date_attr": "datetime"})
    assert a.match("https://foo.com/") and a.match("https://www.foo.com/a") and not a.match("https://bar.com/") and not a.match("https://xfoo.com/")
    assert ConfigAdapter.of({"name": "r", "match_regex": r"/post/\d+"}).match("https://a/post/12") and not ConfigAdapter.of({"name": "r", "match_regex": r"/post/\d+"}).match("https://a/post/x")
    assert [u for u in ("https://foo.com/post/1", "https://foo.com/tag/1", "https://foo.com/about") if a.keep(u)] == ["https://foo.com/post/1"]
    for bad in ({}, {"name": "x"}, {"hosts": ["a"]}):
        with pytest.raises(ValueError):
            ConfigAdapter.of(bad)
    (tmp_path / "a.yaml").write_text("name: y\nhosts: [y.com]\n")
    (tmp_path / "b.json").write_text('[{"name": "z", "hosts": "z.com"}, {"name": "y", "hosts": "q.com"}, {"nope": 1}]')
    (tmp_path / "c.yaml").write_text(": : :")
    reg = Registry()
    assert load(reg, [tmp_path]) == ["y", "z"] and reg.find("https://y.com/1").name == "y" and reg.find("https://n.com") is None
    got = X.extract_page(page(f'<h1>T</h1><time datetime="2020-01-02">x</time><div id=c>{LONG}<p class=x>ad</p></div>'), "https://foo.com/1", a)
    assert got["strategy"] == "adapter:foo" and got["title"] == "T" and got["published_at"] == "2020-01-02" and "ad" not in got["markdown"].split()


def test_failing_hook_leaves_a_note_and_table_essays():
    got = X.extract_page(page(LONG), hook=lambda r: 1 / 0)
    assert any("ZeroDivisionError" in n for n in got["notes"])
    e = table_essays(["e.example"], "Jo")
    html = page('<table><tr><td width=435><img alt="The Title" src=t.gif>March 2009<br><br>' + "Words about it [1] here. " * 30 + "<br><br>[1] Note one.<br><br>[2] Note two.</td></tr></table>")
    got = X.extract_page(html, "https://e.example/x.html", e)
    assert (got["title"], got["author"], got["published_at"]) == ("The Title", "Jo", "2009-03") and "[^1]" in got["markdown"]


def test_extract_table(spark):
    rows = [("https://a.b/1", page(f"<article>{LONG * 5}</article>", "<title>X</title><meta name=date content='2020/5/6'>")), ("https://a.b/2", None), (None, ""), ("https://a.b/3", "<p>" * 500)]
    got = {r.url: r for r in X.extract(spark.createDataFrame(rows, "url string, html string").withColumn("title", F.lit("clash"))).collect()}
    assert got["https://a.b/1"].published_at == "2020-05-06" and got["https://a.b/1"].lang == "en" and got["https://a.b/1"].word_count > 80 and got["https://a.b/1"].notes == []
    assert got["https://a.b/2"].confidence < 0.5 and len(got["https://a.b/2"].notes) == 2


def test_essay_dates_and_images():
    e = table_essays(["e.example"])
    assert e.date_from(parse(""), "2004\n\ntext") == "2004-01" and e.date_from(parse(""), "text\n2004") == "" and e.date_from(parse(""), "in May 1999 or so") == "1999-05"
    r = parse('<table><tr><td><img alt="Title here" src=a><img src=/spacer.gif><img src=real.png alt=x><map><area></map></table><table><tr><td> </table>')
    assert e.title_from(r) == "Title here"
    e.preprocess(r)
    assert [i.get("src") for i in r.find("img")] == ["real.png"] and len(list(r.find("table"))) == 1 and not any(r.find("map"))
