"""Lines repeated across the documents of one site.

Every line is parsed into a template: its letters alone, casefolded, with wildcard slots for the
document's own title and address. Each task puts the templates of its documents into a token tree of
fixed depth: site, length class, first token, last token, leaf. A token is a slot or a block of
letters, as blanks don't count here. A leaf counts the documents that led to it.

The trees of all tasks are returned as rows (site, path, leaf, documents) and merged by summing over
equal paths. The sums bound a template's documents from above, since a document may be read by
several tasks; leaves whose sum reaches the limits make up the merged tree of their site. Lines that
lead to a leaf of the merged tree are the candidates, and only their documents are counted exactly,
as distinct ones. Templates that cover enough documents of their site are boilerplate; their lines
are named and removed.

A site's merged tree is bounded by what a document holds: leaves that cover a share s of the
documents number at most (lines a document) / s. No line is sampled or capped. Leaves are told apart
by site, path and 64 bits of the template.

Nulls: a NULL text has no lines, a NULL address has no site and takes no part, NULL titles fill no
slot, rows with a NULL key or document are left out. Repeated rows count once. Lines without a letter are never boilerplate.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import small, written

MIN_DOCS, MIN_SHARE = 8, 0.15
_LETTERS = re.compile(r"[^\W\d_]+")
#: Leaves a task's tree may hold before it is handed on and a new one begun; merging makes them one again.
LEAVES = 200_000
_SEPARATORS = re.compile(r"\s+[-–—|·»:/]\s+")
TITLE, URL = "\ue000", "\ue001"
SLOTS = TITLE + URL
_SLOT = re.compile(f"[{SLOTS}]")


def site_of(url) -> F.Column:
    """The host in lower case without port and leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def letters(s: str) -> str:
    """The letters of `s`, composed and casefolded."""
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    return "".join(_LETTERS.findall(s)).casefold()


def own_titles(title: str | None, site: str | None) -> list[str]:
    """The letters a document's title slot may hold: first without the site's name after the title, then as it is."""
    if not title:
        return []
    out, name = [title], letters(site or "")
    for m in _SEPARATORS.finditer(title):
        tail = letters(title[m.end() :])
        if tail == name or len(tail) > 4 and tail in name:
            out.append(title[: m.start()])
    found = {x for x in map(letters, out) if x}
    return sorted(found, key=len)


class TemplateTree:
    """Templates of one task in a token tree of fixed depth, with the documents counted at its leaves."""

    WIDTH, BLOCK = 16, 4

    def __init__(self) -> None:
        self.root: dict = {}
        self.leaves = 0

    def path_of(self, template: str) -> str:
        """Length class, first and last token; a slot is a token of its own, whatever it holds."""
        first, last = template[: self.BLOCK], template[-self.BLOCK :]
        if not first.isalpha():
            first = template[0] if template[0] in SLOTS else _SLOT.split(first)[0]
        if not last.isalpha():
            last = template[-1] if template[-1] in SLOTS else _SLOT.split(last)[-1]
        return f"{len(template) // self.WIDTH} {first} {last}"

    def add(self, site: str, template: str, doc: int) -> int:
        """The leaf a template leads to; it counts `doc` unless that was the last one it counted."""
        leaf = xxhash.xxh64_intdigest(f"{site}\0{template}") - (1 << 63)
        under = self.root.setdefault(site, {}).setdefault(self.path_of(template), {})
        got = under.get(leaf)
        if got is None:
            under[leaf] = [1, doc]
            self.leaves += 1
        elif got[1] != doc:
            got[0] += 1
            got[1] = doc
        return leaf

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        """(site, path, leaf, documents)."""
        for site, paths in self.root.items():
            for path, leaves in paths.items():
                for leaf, (n, _) in leaves.items():
                    yield site, path, leaf, n


def templates(text: str, titles: list[str], url: str | None) -> Iterator[tuple[int, list[str]]]:
    """(line number, templates) of the lines with a letter; two templates where a slot was filled."""
    own = re.compile(re.escape(url) + r"(?:#[^\s()\[\]<>\"”»]*)?") if url else None
    own_letters = letters(url) if url else ""
    for no, line in enumerate(text.split("\n"), 1):
        parts = [line]
        if own is not None and url in line:
            parts = own.split(line)
        plain = URL.join(letters(p) for p in parts)
        if not plain.replace(URL, ""):
            if len(parts) > 1:
                yield no, [plain]
            continue
        slotted = plain
        if own_letters and len(parts) == 1 and own_letters in slotted:
            slotted = slotted.replace(own_letters, URL)
        for t in titles:
            if t in slotted:
                slotted = slotted.replace(t, TITLE)
                break
        yield no, [slotted] if slotted == plain else [slotted, plain]


PARSED = "key long, doc long, site string, nos array<int>, ids array<long>, tree array<struct<site:string,path:string,leaf:long,docs:long>>"


LINE_TYPES = {"key": pa.int64(), "doc": pa.int64(), "site": pa.string(), "nos": pa.list_(pa.int32()), "ids": pa.list_(pa.int64())}
TREE_TYPE = pa.list_(pa.struct([("site", pa.string()), ("path", pa.string()), ("leaf", pa.int64()), ("docs", pa.int64())]))


def parse(df: DataFrame, key: str, doc: str, url: str, title: str, text: str, leaves: int = LEAVES) -> DataFrame:
    """Rows of documents (key, doc, site, nos, ids: line numbers and the leaves they lead to) and of trees (tree: their leaves)."""
    src = df.select(
        F.col(key).cast("long").alias("key"), F.col(doc).cast("long").alias("doc"), site_of(F.col(url)).alias("site"), F.col(url).alias("url"), F.col(title).alias("title"), F.col(text).alias("text")
    ).where("site IS NOT NULL AND text IS NOT NULL AND doc IS NOT NULL AND key IS NOT NULL")

    def handed(tree: TemplateTree) -> Iterator[pa.RecordBatch]:
        rows = tree.rows()
        while part := list(itertools.islice(rows, 20_000)):
            cols = [pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.string(), pa.int64(), pa.int64()))]
            leaves = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.StructArray.from_arrays(cols, ["site", "path", "leaf", "docs"]))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in LINE_TYPES.values()], leaves], [*LINE_TYPES, "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = TemplateTree()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                nos, ids = [], []
                for d, s, u, t, x in zip(*(part.column(c).to_pylist() for c in ("doc", "site", "url", "title", "text"))):
                    ln, ti = [], []
                    for no, ts in templates(x, own_titles(t, s), u):
                        for one in ts:
                            ln.append(no)
                            ti.append(grown.add(s, one, d))
                    nos.append(ln)
                    ids.append(ti)
                cols = [part.column("key"), part.column("doc"), part.column("site"), pa.array(nos, LINE_TYPES["nos"]), pa.array(ids, LINE_TYPES["ids"]), pa.nulls(part.num_rows, TREE_TYPE)]
                yield pa.RecordBatch.from_arrays(cols, [*LINE_TYPES, "tree"])
                if grown.leaves >= leaves:
                    yield from handed(grown)
                    grown = TemplateTree()
        yield from handed(grown)

    return src.mapInArrow(run, PARSED)


def merged(trees: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, path, leaf, docs): the trees (tree) as one, with the leaves that enough of the site's `docs` (site, n) may have led to."""
    trees = trees.select(F.inline("tree"))
    one = trees.groupBy("site", "path", "leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    return one.join(docs, "site").where(F.col("docs") >= F.col("n") * min_share).drop("n")


def repeated_lines(df: DataFrame, key: str = "extract_id", doc: str = "article_no", url: str = "url", title: str = "title", text: str = "markdown",
                   min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, line_no) of the lines whose template covers at least `min_docs` documents and `min_share` of its site's."""
    parsed = written(parse(df, key, doc, url, title, text), "site-lines")
    rows = parsed.where("key IS NOT NULL").select("key", "doc", "site", "nos", "ids")
    docs = written(rows.select("site", "doc").distinct().groupBy("site").agg(F.count("*").alias("n")), "site-docs")
    tree = merged(parsed.where("key IS NULL").select("tree"), docs, min_docs, min_share)
    tree = written(tree.groupBy("site").agg(F.collect_set("leaf").alias("leaves")), "site-trees")
    # lines go down their site's merged tree before they are told apart, so the many that end nowhere make no rows
    hits = rows.join(small(tree), "site").select("key", "doc", "site", F.expr("inline(filter(arrays_zip(nos, ids), x -> array_contains(leaves, x.ids)))"))
    hits = written(hits.select(F.col("key").alias("key"), "doc", "site", F.col("nos").alias("line_no"), F.col("ids").alias("leaf")), "site-hits")
    # distinct before the count, with a combine on the map side where a document repeats a line
    covers = hits.select("site", "leaf", "doc").distinct().groupBy("site", "leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs)
    bad = covers.join(docs, "site").where(F.col("c") >= F.col("n") * min_share).select("site", "leaf")
    return hits.join(bad, ["site", "leaf"], "left_semi").select(F.col("key").alias(key), "line_no").distinct()


def remove_lines(df: DataFrame, lines: DataFrame, key: str = "extract_id", text: str = "markdown", out: str = "cleaned") -> DataFrame:
    """`df` with the column `out`: `text` without the named lines (key, line_no)."""
    drop = lines.groupBy(key).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.expr(f"array_join(transform(filter(transform(split(`{text}`, '\\n'), (x, i) -> struct(x AS x, i + 1 AS i)), s -> NOT array_contains(_drop, s.i)), s -> s.x), '\\n')")
    return df.join(drop, key, "left").withColumn(out, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(kept)).drop("_drop")
