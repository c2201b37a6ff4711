"""Articles from pages: one Arrow pass a page, from HTML to Markdown and metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as T
from quire.html import meta as HM
from quire.html import select as S
from quire.html.dom import parse
from quire.html.markdown import Writer

# Share of the text below which cleaning is noted, and from what length.
SHRINK, SHRINK_FROM = 0.25, 2000
SCHEMA = "title string, author string, published_at string, summary string, markdown string, images array<string>, confidence double, strategy string, notes array<string>"


def extract_page(html: str | bytes | None, url: str = "", adapter=None, hook: Callable | None = None, resolve: Callable | None = None, images: bool = True, offset: int | None = None) -> dict:
    """One page's article.

    The adapter's metadata is read before boilerplate goes, as it often stands there; its own steps
    follow the general ones. A failing adapter or hook leaves a note, not an error.
    """
    root = parse(HM.decode(html))
    meta = HM.page_meta(root, url)
    notes: list[str] = []

    def attempt(what: str, f: Callable, default):
        try:
            return f()
        except Exception as e:  # noqa: BLE001  adapters and hooks are foreign code
            notes.append(f"{what}：{type(e).__name__}: {e}")
            return default

    size = len(S.text_of(root))
    S.split_breaks(root)

    def told() -> dict[str, str]:
        if adapter is None:
            return {"title": "", "author": "", "date": ""}
        return {"title": attempt("title", lambda: adapter.title_from(root), ""), "author": attempt("author", lambda: adapter.author_from(root), ""), "date": attempt("date", lambda: adapter.date_from(root, ""), "")}

    early = told()
    if adapter is not None:
        attempt("站点适配器预处理失败", lambda: adapter.preprocess(root), None)
    if hook is not None:
        attempt("自定义预处理失败", lambda: hook(root), None)
    # what the adapter's own steps have laid open counts, else what they took away
    own = {k: v or early[k] for k, v in told().items()}
    S.prune(root)
    if adapter is None and size > SHRINK_FROM and len(S.text_of(root)) < SHRINK * size:
        notes.append("清洗后正文大幅缩短，请人工抽查是否误删")
    node, sure, strategy = S.find_content(root, adapter)
    w = Writer(url, resolve, images)
    md = w.write(node)
    shift = offset if offset is not None else getattr(adapter, "heading_offset", 0)
    md = M.without_title(M.joined(M.shifted(md, shift)), meta.get("title", ""))
    if adapter is not None:
        md = M.joined(attempt("站点适配器后处理失败", lambda: adapter.postprocess(md, meta), md))
    md = M.tidied(md)
    date = attempt("date", lambda: adapter.date_from(root, md), "") if adapter is not None else ""
    return {
        "title": S.tidy(own["title"] or meta.get("title", "")), "author": S.tidy(own["author"] or meta.get("author", "")),
        "published_at": date or own["date"] or meta.get("published_at", ""), "summary": S.tidy(meta.get("summary", "")), "markdown": md,
        "images": w.images, "confidence": sure, "strategy": f"adapter:{adapter.name}" if adapter is not None else strategy, "notes": notes,
    }


def extract(pages: DataFrame, html: str = "html", url: str = "url", registry=None, hook: Callable | None = None, resolve: Callable | None = None) -> DataFrame:
    """`pages` with the article of each: SCHEMA, lang and word_count.

    Only `html` and `url` cross to Python. A page that is NULL or empty gives an empty article with
    low confidence. Columns of `pages` with the same names are replaced.
    """

    @F.pandas_udf(SCHEMA)
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = [extract_page(x, y or "", registry.find(y or "") if registry is not None else None, hook, resolve) for x, y in zip(h, u)]
        return pd.DataFrame(rows, columns=[p.split()[0] for p in SCHEMA.split(", ")])

    fields = [p.split()[0] for p in SCHEMA.split(", ")]
    rest = [c for c in pages.columns if c not in (*fields, "lang", "word_count")]
    df = pages.select(*rest, run(F.col(html), F.col(url)).alias("_a")).select(*rest, *[F.col(f"_a.{f}").alias(f) for f in fields])
    from quire.operators.articles import notes_of

    df = df.withColumn("published_at", T.normalize_date(F.col("published_at"))).withColumn("lang", T.guess_language(F.col("markdown"))).withColumn("word_count", T.count_words(F.col("markdown")))
    return df.withColumn("notes", F.concat("notes", notes_of(F.col("confidence"), F.col("word_count"), F.col("strategy"))))


def page_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with page_title, description and lang_tag by patterns alone, without a tree."""
    h = T.or_empty(F.col(html))
    title = T.strip_tags(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    lang = F.lower(F.regexp_extract(F.regexp_extract(h, r"""(?i)<html[^>]+lang=["']([a-zA-Z\-_]+)["']""", 1), r"^([A-Za-z_]*)", 1))
    return pages.select("*", title.alias("page_title"), meta_value(F.col(html), "description", "og:description").alias("description"), F.when(lang == "zh", "zh-CN").otherwise(lang).alias("lang_tag"))


def meta_value(html: Column, *names: str) -> Column:
    """The first non-empty content of meta elements of these names, whichever attribute comes first."""
    import re

    h = T.or_empty(html)
    tries = []
    for n in names:
        q = re.escape(n)
        for p in (rf"""(?i)<meta[^>]+(?:name|property)=["']{q}["'][^>]*content=["']([^"']*)["']""", rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]*(?:name|property)=["']{q}["']"""):
            tries.append(F.nullif(T.clean_text(F.regexp_extract(h, p, 1)), F.lit("")))
    return F.coalesce(*tries, F.lit(""))
