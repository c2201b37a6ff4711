import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm import sitelines as S

SCHEMA = "extract_id long, article_no long, url string, title string, markdown string"


def rows():
    rnd = random.Random(3)
    out = []
    for site, n in (("big.example", 60), ("mid.example", 12), ("small.example", 5)):
        for i in range(n):
            title = f"A study of kettles, no. {rnd.randrange(1000)} {chr(97 + i % 26)}x{chr(97 + i // 26)}"
            url = f"https://{'www.' if i % 2 else ''}{site.upper() if i % 5 == 0 else site}/p/{chr(97 + i % 26)}-story-{i}"
            lines = [f"Body {chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))} text."]
            if i % 4:
                lines.append(["All rights reserved 2020", "> **All  Rights** reserved!"][i % 2])
            if i % 3:
                lines.append(f"Cite as {title} ({url})")
            if i < 9:
                lines.append("nine times only here")
            lines += ["", "---", "12345"]
            out.append((i + 1000 * len(out), hash((site, i)) % 10**9, url, title + (f" – {site}" if i % 2 else ""), "\n".join(lines)))
    return out


def brute(data):
    let = lambda s: "".join(re.findall(r"[^\W\d_]+", s)).casefold()
    sites, docs, where = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, d, u, t, m in set(data):
        site = re.sub(r"^www\.", "", u.split("/")[2].lower())
        t = t.split(" – ")[0]
        sites[site].add(d)
        for no, line in enumerate(m.split("\n"), 1):
            x = let(line.replace(u, "")) and let(line.replace(u, "\x01")).replace(let(t), "T")
            if let(line):
                docs[site, x].add(d)
                where[site, x].add((k, no))
    return {w for key, v in docs.items() if len(v) >= 8 and len(v) >= 0.15 * len(sites[key[0]]) for w in where[key]}


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data + data[:20], SCHEMA).repartition(5)
    got = {tuple(r) for r in S.repeated_lines(df).collect()}
    assert got == brute(data) and len(got) > 80


def test_removal_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, 1, "https://a.b/c", "t", "x\n\ny\nx"), (2, 2, "https://a.b/d", "t", None), (3, 3, "https://a.b/e", "t", "")], SCHEMA).withColumn("line_no", F.lit(9))
    lines = spark.createDataFrame([(1, 1), (1, 4)], "extract_id long, line_no int")
    got = {r.extract_id: r.cleaned for r in S.remove_lines(df, lines).collect()}
    assert got == {1: "\ny", 2: None, 3: ""}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None, "t", "x"), (2, None, "https://a.b", "t", "x"), (3, 3, "https://a.b", None, None), (None, 3, "https://a.b", None, "x")], SCHEMA)
    assert S.repeated_lines(df).count() == 0 and S.repeated_lines(df.limit(0)).count() == 0
    assert S.repeated_lines(df.withColumn("url", F.lit("https://a.b/x")), min_docs=1, min_share=0.0).count() == 1


def test_titles_without_the_site():
    assert S.own_titles("Maps: a guide – my-site.example", "my-site.example")[0] == S.letters("Maps: a guide")
    assert S.own_titles(None, None) == []


def test_trees_of_two_tasks_merge_a_slot(spark):
    """The same prompt quotes another title in each document; both tasks' trees lead it to one leaf behind a wildcard."""
    def one(i, t):
        return (i, i, f"https://a.example/{i}", t, f"Share {t} with friends\nOnly here {t[::-1]}")

    titles = ["Old kettles", "New bread", "Far harbours", "Wet ropes", "Tall trees", "Low tide", "Red clay", "Dry stone", "Late rain"]
    df = spark.createDataFrame([one(i, t) for i, t in enumerate(titles)], SCHEMA).repartition(2, "article_no")
    trees = S.parse(df, "extract_id", "article_no", "url", "title", "markdown").where("key IS NULL").select("tree")
    rows = trees.select(F.inline("tree")).where("docs > 1").collect()
    assert len(rows) == 2 and len({(r.path, r.leaf) for r in rows}) == 1
    docs = spark.createDataFrame([("a.example", 9)], "site string, n long")
    got = S.merged(trees, docs).collect()
    assert [r.docs for r in got] == [9] and got[0].path == rows[0].path
    # a tree handed on after every few leaves merges to the same
    early = S.parse(df, "extract_id", "article_no", "url", "title", "markdown", leaves=3).where("key IS NULL").select("tree")
    assert S.merged(early, docs).collect() == got
    found = {(r.extract_id, r.line_no) for r in S.repeated_lines(df).collect()}
    assert found == {(i, 1) for i in range(9)}


def test_path_stops_at_slots():
    t = S.TemplateTree()
    assert t.path_of(f"ab{S.TITLE}cdefgh") == "0 ab efgh"
    assert t.path_of(f"{S.TITLE}cdefgh{S.URL}") == f"0 {S.TITLE} {S.URL}"
    assert t.add("s", "abc", 1) == t.add("s", "abc", 1) and list(t.rows())[0][3] == 1
