import math
import random
from itertools import product

from pyspark.sql import functions as F

from quire.llm import boilerplate as B
from quire.llm.charlm import CharModel

rnd = random.Random(5)
W = "quiet slow narrow winter copper baker porter teacher repairs measures keeps letter ledger bridge window".split()


def para():
    return "The " + " ".join(rnd.choice(W) for _ in range(14)) + ". And " + " ".join(rnd.choice(W) for _ in range(9)) + "."


FURNITURE = [("nav", "nav", "Home | About | Contact"), ("div", "cookie", "We use cookies to count visitors. Accept all"), ("footer", "footer", "© 2020 site.example - All rights reserved"), ("div", "share", "Share: mail / print")]


def page(named=True):
    body, text, bad = [], [], []
    parts = [("p", None, para()) for _ in range(4)] + rnd.sample(FURNITURE, 3)
    rnd.shuffle(parts)
    for tag, cls, s in parts:
        if cls is None:
            body.append(f"<p>{s}")
        elif named:
            body.append(f'<{tag} class="{cls}">{s}</{tag}>')
        else:
            body.append(f'<div class="b{rnd.randrange(99)}">{s}</div>')
        text.append(s)
        bad.append(cls is not None)
    return f"<html><body>{''.join(body)}</body></html>", "\n\n".join(text), bad


def model():
    got = [page(rnd.random() < 0.7) for _ in range(150)]
    return B.Model({f"u{i}": h for i, (h, _, _) in enumerate(got)}, [(f"u{i}", t) for i, (_, t, _) in enumerate(got)], CharModel([para() for _ in range(50)]))


def test_sum_product_against_enumeration():
    p = B.Potentials([])
    p.same = (0.9, 0.7)
    p.weight = {"a": 1.0, "b": -2.0, "c": 0.5}
    t = B.Tree()
    r = t.add(-1, ["c"])
    x = t.add(r, ["a"])
    t.add(x, ["b"])
    t.add(x, ["a"])
    t.add(r, ["b"])
    got = p.marginals(t)
    own = [p.odds(s) for s in t.seen]
    s0, s1 = p.same
    edge = {(0, 0): s0, (0, 1): 1 - s0, (1, 1): s1, (1, 0): 1 - s1}
    total, on = 0.0, [0.0] * 5
    for ys in product((0, 1), repeat=5):
        w = math.exp(sum(o * y for o, y in zip(own, ys)))
        for i in range(1, 5):
            w *= edge[ys[t.parent[i]], ys[i]]
        total += w
        for i, y in enumerate(ys):
            on[i] += w * y
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(got, on))


def test_held_out_pages_and_markdown():
    m = model()
    right = n = 0
    for _ in range(40):
        h, t, bad = page(named=False)
        lines = m.page_lines(h)
        md = m.markdown_lines(t)
        for s, y, (_, _, p) in zip(t.split("\n\n"), bad, md):
            right += (lines[B.key_of(s)] < 0.5) == y
            right += (p < 0.5) == y
            n += 2
    assert right / n > 0.97


def test_tables(spark):
    m = model()
    h, t, bad = page()
    ex = spark.createDataFrame([(1, "u", t), (1, "u", t), (2, "v", t), (3, None, t), (4, "u", None), (5, "u", ""), (None, "u", "x")], "key long, url string, text string")
    pages = spark.createDataFrame([("u", h), ("u", "�"), (None, h), ("w", None)], "url string, html string").withColumn("at", F.current_timestamp())
    got = B.label_lines(ex, pages, m).distinct().collect()
    assert {r.key for r in got} == {1, 2, 3} and {r.on_page for r in got if r.key == 1} == {True} and {r.on_page for r in got if r.key == 2} == {False}
    assert [r.content < 0.5 for r in sorted((r for r in got if r.key == 1), key=lambda r: r.line_no)] == bad
    assert B.label_lines(ex.limit(0), pages.limit(0), m).count() == 0
    empty = B.fit(pages.select("url", "html").limit(0), ex.select("url", "text").limit(0), CharModel([]))
    assert B.label_lines(ex, pages, empty).count() > 0


def test_every_page_and_extract_trains(spark):
    """Trained in tasks on thousands of pages, the model is that of all of them together."""
    got = [page(i % 3 > 0) for i in range(2500)]
    pages = spark.createDataFrame([(f"u{i}", h) for i, (h, _, _) in enumerate(got)] + [("bad", "\ufffd"), ("", ""), (None, "<p>x")], "url string, html string")
    ex = spark.createDataFrame([(f"u{i}", t) for i, (_, t, _) in enumerate(got)] + [("none", "x"), (None, "x"), ("u1", None)], "url string, text string")
    chars = CharModel([para() for _ in range(50)])
    m = B.fit(pages, ex, chars)
    whole = B.Model({f"u{i}": h for i, (h, _, _) in enumerate(got)}, [(f"u{i}", t) for i, (_, t, _) in enumerate(got)], chars)
    assert m.page.n == whole.page.n and m.markdown.n == whole.markdown.n and sum(m.markdown.n) > 2500 * 7
    for a, b in ((m.page, whole.page), (m.markdown, whole.markdown)):
        assert a.weight == b.weight and a.same == b.same


def test_pages_are_labelled_once(spark):
    """The lines that training labels are those of the latest sound page of an address."""
    got = [page() for _ in range(60)]
    rows = [(f"u{i}", h, 5) for i, (h, _, _) in enumerate(got)] + [("u0", got[1][0], 4), ("u1", "\ufffd", 9), ("u2", got[3][0], 9), ("u3", "", 9), ("u4", got[4][0], 5)]
    pages = spark.createDataFrame(rows, "url string, html string, s long").selectExpr("url", "html", "timestamp_seconds(s) AS at")
    ex = spark.createDataFrame([(i, f"u{i}", t) for i, (_, t, _) in enumerate(got)] + [(99, "none", got[0][1])], "key long, url string, text string")
    m, lines = B.train(pages, ex.select("url", "text"), CharModel([para() for _ in range(50)]))
    at = {r.url: r for r in lines.collect()}
    assert len(at) == 60 == lines.count() and len(at["u3"]["keys"]) == 0
    for u, h in (("u0", got[0][0]), ("u1", got[1][0]), ("u2", got[3][0])):
        assert dict(zip(at[u]["keys"], at[u]["probs"])) == m.page_lines(h)
    assert sorted(B.label_lines_on(ex, lines, m).collect()) == sorted(B.label_lines(ex, pages, m).collect())
