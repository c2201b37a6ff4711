import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import queries
from quire.__main__ import main
from quire.streaming import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def rows(found):
    return Counter(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name in queries.ORACLE:
        want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
        assert rows(got) == rows(want)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(queries.QUERIES) <= set(q)


def test_core_does_not_import_llm():
    for top, _, files in os.walk(f"{ROOT}/quire"):
        if "/llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"quire\.llm|from \.+llm|import llm", open(f"{top}/{f}").read()), f


def test_without_llm(tmp_path):
    """With both folders deleted the entry has the core's queries, all tests are collected, and those without tables pass."""
    for name in ("quire", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path, env=env, check=True, capture_output=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_functions.py", "tests/test_html.py"], cwd=tmp_path, env=env, check=True, capture_output=True)


def test_a_broken_import_in_llm_is_an_error(tmp_path):
    shutil.copytree(f"{ROOT}/quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "quire" / "llm").mkdir()
    (tmp_path / "quire" / "llm" / "__init__.py").touch()
    (tmp_path / "quire" / "llm" / "queries.py").write_text("import not_there\n")
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert b"not_there" in subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True).stderr


def test_command_line(sf, tmp_path, capsys):
    out = str(tmp_path / "b.epub")
    assert main(["pack", sf, "-o", out, "--title", "T"]) == 0 and main(["check", out]) == 0 and main(["themes"]) == 0 and main(["queries"]) == 0
    assert main(["--json", "group", sf, "--by", "path", "--max", "5"]) == 0
    assert "篇" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nope"])


def test_incremental_ingest(spark, sf, tmp_path):
    f = spark.read.parquet(f"{sf}/fetches.parquet").where("ok").select("url", F.col("text").alias("html"), "fetched_at")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    f.where("length(url) % 2 = 0").write.parquet(f"{src}/a")
    for extra in (None, "b"):
        if extra:
            f.write.parquet(f"{src}/{extra}")
        ingest.start(ingest.read_pages(spark, f"{src}/*"), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    n = f.select(F.substring_index("url", "#", 1)).distinct().count()
    assert got.count() == n == got.select("idx").distinct().count() and got.agg(F.max("idx")).first()[0] == n
    # a batch that runs again changes nothing
    ingest.write_batch(f, 1, out)
    assert spark.read.parquet(out).select("key").distinct().count() == n == spark.read.parquet(out).count()


def test_event_time(spark, sf):
    q = ingest.hourly(spark.read.parquet(f"{sf}/fetches.parquet"))
    assert q.agg(F.sum("pages")).first()[0] == spark.read.parquet(f"{sf}/fetches.parquet").where("fetched_at IS NOT NULL").count()
    s = spark.readStream.schema(spark.read.parquet(f"{sf}/fetches.parquet").schema).parquet(f"{sf}/fetches.parquet*")
    w = ingest.first_seen(s).select("key").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    w.awaitTermination()
    got = spark.table("seen")
    assert got.count() == got.distinct().count() > 0
