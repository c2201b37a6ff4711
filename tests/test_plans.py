import random

import pytest
from pyspark.sql import functions as F

from quire.operators import articles as A
from quire.operators import hierarchy as H
from quire.operators import titles as TT
from quire.operators.ranking import row_numbers
from quire.plans import grouping as G
from quire.plans import taxonomy as X

ENTRY = "url string, title string, date string, seq long"
CAT = "id int, site string, name string, slug string, parent int, n_posts int, description string"


def entries(spark, *rows):
    return spark.createDataFrame([(u, "", d, i) for i, (u, d) in enumerate(rows)], ENTRY)


def parts(plan):
    out = {}
    for r in plan.orderBy("part_no", "section_no", "pos").collect():
        out.setdefault(r.part_title, []).append(r.url)
    return out


def test_by_date(spark):
    e = entries(spark, ("u3", "2021-05-01"), ("u1", "2019-01-01"), ("u2", "2021-02-01"), ("u9", ""), ("u0", None), ("u4", "soon"))
    got = parts(G.by_date(e))
    assert list(got) == ["2019", "2021", "未标日期"] and got["2021"] == ["u2", "u3"] and got["未标日期"] == ["u9", "u0", "u4"]


def test_by_path_and_flat(spark):
    e = entries(spark, ("https://x/tutorial/b", ""), ("https://x/tutorial/a", "2020"), ("https://x/news/c", ""))
    got = parts(G.by_path(e))
    assert list(got) == ["tutorial", "news"] and got["tutorial"] == ["https://x/tutorial/b", "https://x/tutorial/a"]
    assert parts(G.by_flat(e)) == {"": ["https://x/news/c", "https://x/tutorial/b", "https://x/tutorial/a"]}


def test_strategies(spark):
    assert G.choose_strategy("api") == "category" and G.choose_strategy("") == "date" and G.choose_strategy("api", "flat") == "flat"
    with pytest.raises(ValueError):
        G.build_plan(entries(spark, ("u", "")), "nope")
    with pytest.raises(ValueError):
        G.build_plan(entries(spark).limit(0), "date")


def test_orphans(spark):
    e = entries(spark, ("u1", "2020"), ("u2", "2020"), ("u3", ""), ("u4", ""))
    plan = G.by_date(e.where("seq < 2"))
    got = G.rescue_orphans(plan, e.select("url", "seq"))
    assert parts(got)["未分类"] == ["u3", "u4"] and G.rescue_orphans(plan, e.where("seq < 2").select("url", "seq")).count() == 2


def test_places_and_leftovers(spark):
    e = entries(spark, ("a#x", "2020"), ("b", "2021"), ("a", "2022"))
    plan = G.by_date(e)
    ch = spark.createDataFrame([("a", 1), ("c", 2)], "url string, n int")
    once = G.place_once(plan, ch).collect()
    assert len(once) == 1 and once[0].part_title == "2020"
    assert [r.n for r in G.leftovers(plan, ch).collect()] == [2]
    assert [r.part_title for r in G.attach(ch, plan).orderBy("n").collect()] == ["2022", ""]
    assert sorted(r.part_no for r in G.renumber(G.kept(plan, ch)).collect()) == [1, 2]


def test_round_robin_is_fair(spark):
    e = entries(spark, *[(f"u{i}", "2019" if i < 50 else "2020" if i < 53 else "2021") for i in range(60)])
    got = parts(G.round_robin(G.by_date(e), 12))
    assert {k: len(v) for k, v in got.items()} == {"2019": 5, "2020": 3, "2021": 4}


def test_nested_round_trip_and_summary(spark):
    e = entries(spark, ("u1", "2020"), ("u2", "2021"), ("u3", "2021"))
    plan = G.by_date(e)
    back = G.flat(G.nested(plan))
    assert sorted(map(tuple, back.select("part_no", "pos", "url").collect())) == sorted(map(tuple, plan.select("part_no", "pos", "url").collect()))
    assert any("2 篇" in r.line for r in G.summary_lines(plan).collect())
    own = spark.createDataFrame([(1, "t", "s", None, ["a", "b"])], "part_no long, title string, slug string, subgroups array<struct<title:string,slug:string,urls:array<string>>>, urls array<string>")
    assert G.flat(own).count() == 2
    r = G.rollup(plan, spark.createDataFrame([("u1", 5), ("u2", 7)], "url string, words int")).where("part_no IS NULL").first()
    assert (r.n_articles, r.words) == (3, 12)


def test_priority_and_theme_order(spark):
    c = lambda *rows: spark.createDataFrame([(i, "s", n, sl, p, k, "") for i, n, sl, p, k in rows], CAT)
    first = lambda df: [r.slug for r in df.orderBy(df.columns[-1]).collect()]
    assert first(X.auto_priority(c((1, "Top", "top", 0, 0), (2, "Sub", "sub", 1, 0))))[0] == "sub"
    assert first(X.auto_priority(c((1, "B", "broad", 0, 500), (2, "N", "narrow", 0, 3))))[0] == "narrow"
    assert first(X.auto_theme_order(c((1, "项目", "x", 0, 400), (2, "资源", "z", 0, 20), (3, "随笔", "suibi", 0, 1200)))) == ["x", "z", "suibi"]
    assert X.auto_theme_order(c((1, "A", "a", 0, 5))).count() == 0
    d = {r.id: r.depth for r in X.depths(c((1, "", "a", 0, 0), (2, "", "b", 1, 0), (3, "", "c", 99, 0), (4, "", "d", 3, 0), (5, "", "e", 6, 0), (6, "", "f", 5, 0), (7, "", "g", 7, 0), (8, "", "h", 7, 0))).collect()}
    assert d == {1: 0, 2: 1, 3: 1, 4: 2, 5: 32, 6: 32, 7: 32, 8: 32}


def test_category_plan(spark):
    cats = spark.createDataFrame([(1, "s", "Top", "top", 0, 9, ""), (2, "s", "Sub！", "sub", 1, 3, ""), (3, "s", "Deep", "deep", 2, 1, ""), (4, "s", "Other", "other", None, 1, "")], CAT)
    posts = spark.createDataFrame([(1, "s", "http://l/1", "2020", [1]), (2, "s", "http://l/2", "2019", [1, 2]), (3, "s", "http://l/3", "2018", [3]), (4, "s", "http://l/4", "", [99]), (5, "s", "", "", [1]), (6, "s", "http://l/6", None, None)], "id int, site string, link string, date_str string, categories array<int>").withColumn("modified_at", F.current_timestamp()).withColumn("loaded_at", F.current_timestamp())
    plan = X.by_category(cats, posts)
    got = [(r.part_title, r.section_title, r.url) for r in plan.orderBy("part_no", "section_no", "pos").collect()]
    assert got == [("Top", "Sub", "http://l/2"), ("Top", "综合", "http://l/1")]
    assert X.by_category(cats.limit(0), posts).count() == 0


def brute_forest(parent):
    cyc = {}
    for i in parent:
        seen, x = [], i
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x == i:
            cyc[i] = min(seen)
    return cyc


def test_hierarchy_against_brute_force(spark):
    rnd = random.Random(7)
    parent = {i: rnd.choice([0, None, 999, *range(1, 120)]) if i > 60 else max(0, i - 1) for i in range(1, 120)}
    rows = [(i, "s", "", rnd.choice(["", None, f"s{i}"]), p, 1, "") for i, p in parent.items()] + [(None, "s", "", "x", 1, 1, "")]
    h = H.build(spark.createDataFrame(rows + rows[:9], CAT).selectExpr("*", "1 AS depth", "2 AS root", "3 AS path"))
    cyc = brute_forest(parent)
    assert {r.id: r.cycle_id for r in h.cycles.collect()} == cyc
    got = {r.id: r for r in h.paths().collect()}
    assert set(got) == set(parent)
    pairs = set()
    for i in parent:
        line, x = [i], i
        while parent.get(x) in parent and len(line) < 200:
            x = parent[x]
            line.append(x)
        if len(line) < 200:
            assert (got[i].depth, got[i].root) == (len(line), line[-1]) and len(got[i].path.split("/")) == len(line)
            pairs |= {(a, i, k) for k, a in enumerate(line) if k}
        else:
            assert got[i].depth is None and got[i].state == ("cycle" if i in cyc else "behind_cycle")
    assert {tuple(r) for r in h.descendants().collect()} == pairs


def test_hierarchy_of_nothing(spark):
    h = H.build(spark.createDataFrame([], CAT))
    assert h.paths().count() == 0 and h.cycles.count() == 0 and h.descendants().count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_row_numbers(spark, few):
    df = spark.range(500).selectExpr("id", "CASE WHEN id < 300 THEN NULL ELSE id % 3 END AS g", "xxhash64(id) AS k")
    got = {(r.g, r.k): r.rn for r in row_numbers(df.repartition(7), ["g"], [("k", "desc")], few=few).collect()}
    want = {}
    for g in (None, 0, 1, 2):
        for n, k in enumerate(sorted((r.k for r in df.collect() if r.g == g), reverse=True), 1):
            want[g, k] = n
    assert got == want and row_numbers(df.limit(0), [], ["id"], few=few).count() == 0
    assert [r.rn for r in row_numbers(df, [], ["id"], few=few).orderBy("id").collect()] == list(range(1, 501))



def test_unique_slugs_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", "a-2", "a-3", "a-2-2", "c", "b-4", "untitled", "-2"])) for i in range(300)]
    used = {"c", "b-2"}
    got = {r.seq: r.id for r in A.unique_slugs(spark.createDataFrame(rows, "seq long, slug string"), used=spark.createDataFrame([(u,) for u in used], "slug string")).collect()}
    taken, want = set(used), {}
    for i, s in rows:
        n, x = 2, s
        while x in taken:
            x, n = f"{s}-{n}", n + 1
        taken.add(x)
        want[i] = x
    assert got == want


def test_titles(spark):
    v = lambda t, *n: spark.range(1).select(TT.strip_site_suffix(F.lit(t), *map(F.lit, n)).alias("x")).first().x
    assert v("Post - Site", "Site") == "Post" and v("Post – S.(ite", "S.(ite") == "Post" and v("Post | Blog", "Blog - Home") == "Post"
    assert v("a - b", "c") == "a - b" and v("", "x") == "" and v("A - B - B", "B") == "A - B" and v("Site", "Site") == "Site" and v("Post", "") == "Post"
    t = spark.createDataFrame([(f"T{i} | Tail", i) for i in range(5)] + [("Other", 9), (None, 10)], "title string, seq int")
    got = {r.seq: r.clean_title for r in TT.strip_common_tail(t).collect()}
    assert got[0] == "T0" and got[9] == "Other" and got[10] == ""
    few = t.where("seq < 2 OR seq > 8")
    assert [r.clean_title for r in TT.strip_common_tail(few).where("seq = 0").collect()] == ["T0 | Tail"]


def test_audit_and_orders(spark):
    a = spark.createDataFrame([(1, "x", "f1", ["a.png"], "ok", ""), (2, "x", "f2", [], "failed", ""), (3, "z", "f3", None, "partial", "why")], "idx int, id string, file string, assets array<string>, fetch_status string, notes string")
    files = spark.createDataFrame([("f1", " "), ("f2", "t"), ("f9", "o")], "file string, body string")
    got = sorted((r.level, r.article, r.msg) for r in A.audit(a, files, spark.createDataFrame([], "path string")).collect())
    assert got == [("error", "x", "id 重复"), ("error", "x", "抓取失败"), ("error", "z", "正文文件缺失：f3"), ("warn", "x", "正文为空"), ("warn", "x", "资源缺失：a.png"), ("warn", "z", "why")]
    assert [r.file for r in A.orphan_files(files, a).collect()] == ["f9"]
    assert A.audit(a.limit(0), files, spark.createDataFrame([], "path string")).first().msg == "归档包内没有文章"
    d = spark.createDataFrame([(0, "B", "2020-05"), (1, "a", ""), (2, "C", "2021-01-02"), (3, "d", "2020-05-01"), (4, "e", "soon")], "seq int, title string, published_at string")
    order = lambda o: [r.seq for r in A.ordered(d, o).orderBy("pos").collect()]
    assert order("reverse") == [4, 3, 2, 1, 0] and order("alpha") == [1, 0, 2, 3, 4] and order("date-asc") == [0, 3, 2, 1, 4] and order("date-desc") == [4, 2, 3, 0, 1]
    r = d.withColumnRenamed("seq", "idx").withColumn("id", F.col("title"))
    over = spark.createDataFrame([("a", "2022-01"), ("B", "1999")], "id string, date string")
    assert [x.idx for x in A.reordered(r, "date-desc", over).orderBy("pos").collect()] == [1, 2, 0, 3, 4]
    items = spark.createDataFrame([("u1", 1), ("u2#f", 2), ("u3", 3)], "url string, seq int")
    known = spark.createDataFrame([("u2",)], "source_url string")
    assert {x.url for x in A.todo(items, known).collect()} == {"u1", "u3"} and {x.url for x in A.todo(items, known, 2).collect()} == {"u1"}


def test_plan_files(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"groups": [{"title": "A", "subgroups": [{"title": "s", "urls": ["u1", "u2"]}]}, {"title": "B", "urls": ["u3"]}]}')
    assert parts(G.read_json(spark, str(p))) == {"A": ["u1", "u2"], "B": ["u3"]}
    p.write_text('[{"title": "A", "urls": ["u1"]}]')
    assert parts(G.read_json(spark, str(p))) == {"A": ["u1"]}
    p.write_text('{"x": 1}')
    with pytest.raises(ValueError):
        G.read_json(spark, str(p))
