"""Plans from a site's categories: each post goes to its deepest category, and under that one's root.

Climbing is done by doubling: a step of one parent, then two, four, ..., so a walk of at most n
steps takes log2(n) self-joins of the categories, whatever the shape of the tree; walks on circles
end after n steps. Categories and posts of several sites are planned side by side, by `site`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.url import is_http
from quire.operators.ranking import row_numbers
from quire.plans.grouping import ORPHAN_SECTION, SELF_SLUG
from quire.session import written

# Steps after which a walk to the root ends, and the outlier rule for a catch-all part.
TOP_STEPS, DEPTH_STEPS, OUTLIER = 12, 32, 2.5


def clean_categories(categories: DataFrame) -> DataFrame:
    """One row an id: (id, site, slug, name, parent, n_posts); missing values '' and 0."""
    c = categories.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(
        T.or_empty(F.col("site")).alias("site"), T.or_empty(F.col("slug")).alias("slug"), T.or_empty(F.col("name")).alias("name"),
        F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
    )).alias("v"))
    return c.select("id", "v.*")


def climb(nodes: DataFrame, limit: int, dangling: bool = False) -> DataFrame:
    """(id, top, steps): where a walk along `parent` of at most `limit` steps ends, and its length.

    The walk ends at a node without parent, or whose parent isn't among the nodes; with `dangling`
    the step to such a parent still counts.
    """
    return climbs(nodes, {limit: dangling})[limit]


def climbs(nodes: DataFrame, limits: dict[int, bool]) -> dict[int, DataFrame]:
    """`climb` for several limits, which share the doubled steps; the values say whether a dangling step counts."""
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    one = nodes.select("id", "parent").join(known, "parent", "left")
    step = F.col("known").isNotNull()
    # a step to a missing parent is taken once, at the end of a walk
    one = one.select("id", F.when(step, F.col("parent")).otherwise(F.col("id")).alias("top"), F.when(step, 1).otherwise(0).alias("steps"), (~step & (F.col("parent") != 0)).alias("dangles"))
    first = power = written(one, "climb")
    ends = first.where("dangles").select(F.col("id").alias("end"))
    power = first.drop("dangles")
    left, done = dict.fromkeys(limits), {}
    for bit in range(max(limits).bit_length()):
        for n in limits:
            if n >> bit & 1:
                left[n] = power if left[n] is None else _then(left[n], power)
        if max(limits) >> (bit + 1):
            power = written(_then(power, power), "climb")
    for n, dangling in limits.items():
        done[n] = left[n]
        if dangling:
            j = done[n].join(ends, F.col("top") == F.col("end"), "left")
            done[n] = j.select("id", "top", F.least(F.col("steps") + F.when(F.col("end").isNotNull(), 1).otherwise(0), F.lit(n)).alias("steps"))
    return done


def _then(a: DataFrame, b: DataFrame) -> DataFrame:
    """The walk `a` followed by the walk `b`."""
    nxt = b.select(F.col("id").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"))
    return a.join(nxt, "top").select("id", F.col("top2").alias("top"), (F.col("steps") + F.col("steps2")).alias("steps"))


def depths(categories: DataFrame) -> DataFrame:
    """(id, depth): steps to the root, a step to a missing parent included, up to DEPTH_STEPS."""
    return climb(clean_categories(categories), DEPTH_STEPS, dangling=True).select("id", F.col("steps").cast("long").alias("depth"))


def auto_priority(categories: DataFrame) -> DataFrame:
    """(site, id, slug, priority) from 1: deeper first, then narrower, then by id; categories without slug are left out."""
    return _priority(clean_categories(categories), depths(categories))


def _priority(c: DataFrame, deep: DataFrame) -> DataFrame:
    c = c.join(deep, "id").where("slug <> ''")
    return row_numbers(c, ["site"], [("depth", "desc"), "n_posts", "id"], "priority").select("site", "id", "slug", "priority")


def auto_theme_order(categories: DataFrame) -> DataFrame:
    """(site, id, slug, theme_no): roots by id, but last one whose posts outnumber the upper median by OUTLIER; sites with fewer than two roots or no such root are absent."""
    return _theme_order(clean_categories(categories))


def _theme_order(c: DataFrame) -> DataFrame:
    tops = c.where("parent = 0")
    # the upper median is the discrete median of the descending order
    m = tops.groupBy("site").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_posts DESC)").alias("median"), F.max_by("id", F.struct("n_posts", -F.col("id"))).alias("big"), F.max("n_posts").alias("most"))
    m = m.where((F.col("n") > 1) & (F.col("median") > 0) & (F.col("most") > OUTLIER * F.col("median"))).select("site", "big")
    c = tops.join(m, "site")
    return row_numbers(c, ["site"], [(F.col("id") == F.col("big")).cast("int"), "id"], "theme_no").select("site", "id", "slug", "theme_no")


def in_order(slug: Column, wanted: list[str] | None, otherwise: Column) -> Column:
    """A sortable place: slugs of `wanted` in its order, all others behind them by `otherwise`; without a list `otherwise` alone."""
    if not wanted:
        return F.struct(F.lit(0).alias("listed"), otherwise.cast("long").alias("place"))
    at = F.array_position(F.array(*[F.lit(w) for w in wanted]), slug)
    return F.struct(F.when(at > 0, 0).otherwise(1).alias("listed"), F.when(at > 0, at).otherwise(otherwise).cast("long").alias("place"))


def clean_posts(posts: DataFrame) -> DataFrame:
    """One row an id with a link: the one loaded last."""
    p = posts.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("site", "link", F.col("date_str").alias("date"), "categories"), F.struct("loaded_at", "modified_at", "link")).alias("v")).select("id", "v.*")
    return p.select("id", T.or_empty(F.col("site")).alias("site"), T.strip(T.or_empty(F.col("link"))).alias("link"), T.or_empty(F.col("date")).alias("date"), "categories").where("link <> ''")


def pick_category(posts: DataFrame, categories: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """(id, site, category, top, depth): of a post's categories the deepest, then by priority, then by id; posts without any are absent."""
    c = clean_categories(categories)
    return _pick(posts, c, climb(c, TOP_STEPS), priority)


def _pick(posts: DataFrame, c: DataFrame, tops: DataFrame, priority: DataFrame | None) -> DataFrame:
    info = c.select("id", "slug").join(tops, "id")
    if priority is not None:
        # a slug stands for all categories of its site that have it
        pr = priority.groupBy("site", "slug").agg(F.min("priority").alias("priority"))
        info = info.join(c.select("id", "site"), "id").join(pr, ["site", "slug"], "left").drop("site")
    else:
        info = info.withColumn("priority", F.lit(None).cast("long"))
    each = posts.select("id", "site", F.explode("categories").alias("category")).distinct()
    j = each.join(info.select(F.col("id").alias("category"), "top", "steps", "priority"), "category")
    key = F.struct(-F.col("steps"), F.coalesce("priority", F.lit(1 << 40)), F.col("category"))
    return j.groupBy("id", "site").agg(F.min_by(F.struct("category", "top", "steps"), key).alias("v")).select("id", "site", "v.category", "v.top", F.col("v.steps").cast("long").alias("depth"))


def by_category(categories: DataFrame, posts: DataFrame, fallback: str = ORPHAN_SECTION, theme_order: list[str] | None = None, section_order: list[str] | None = None) -> DataFrame:
    """The plan of every site, with the column site: parts are root categories, sections their children.

    Posts in a root go to a last section `fallback`; posts in deeper categories than a root's child
    have no section of their own and are left for `rescue_orphans`. Posts are ordered by (date, id).
    `theme_order` and `section_order` are slugs: parts and sections in them come first, in their order,
    the others behind by id. Without a `theme_order` parts have the automatic order.
    """
    c = written(clean_categories(categories), "categories")
    p = written(clean_posts(posts), "posts")
    walks = climbs(c, {TOP_STEPS: False, DEPTH_STEPS: True})
    deep = walks[DEPTH_STEPS].select("id", F.col("steps").cast("long").alias("depth"))
    chosen = _pick(p, c, walks[TOP_STEPS], _priority(c, deep))
    order = _theme_order(c).select(F.col("id").alias("top"), "theme_no") if not theme_order else c.select(F.col("id").alias("top"), F.lit(None).cast("long").alias("theme_no")).limit(0)
    top = c.select(F.col("id").alias("top"), F.col("slug").alias("part_slug"), T.clean_category_title(F.col("name")).alias("part_title"))
    sec = c.select(F.col("id").alias("category"), F.col("parent").alias("_parent"), F.col("slug").alias("_slug"), T.clean_category_title(F.col("name")).alias("_name"))
    rows = chosen.join(p.drop("site"), "id").join(top, "top").join(sec, "category").join(order, "top", "left")
    own = F.col("depth") == 0
    rows = rows.where(own | (F.col("_parent") == F.col("top")))
    rows = rows.select(
        "site", "id", "date", "top", F.col("link").alias("url"), "part_title", "part_slug", in_order(F.col("part_slug"), theme_order, F.coalesce("theme_no", F.col("top").cast("long"))).alias("_po"),
        F.when(own, fallback).otherwise(F.col("_name")).alias("section_title"), F.when(own, SELF_SLUG).otherwise(F.col("_slug")).alias("section_slug"),
        F.when(own, F.struct(F.lit(2).alias("listed"), F.lit(0).cast("long").alias("place"))).otherwise(in_order(F.col("_slug"), section_order, F.col("category"))).alias("_so"), "category",
    )
    rows = written(rows.withColumn("_so", F.struct("_so", F.when(F.col("_so.listed") == 2, 0).otherwise(F.col("category")).alias("id"))).drop("category"), "planned")
    parts = row_numbers(rows.select("site", "top", "_po").distinct(), ["site"], ["_po", "top"], "part_no").drop("_po")
    sections = row_numbers(rows.select("site", "top", "_so").distinct(), ["site", "top"], ["_so"], "section_no")
    numbered = row_numbers(rows, ["site", "top", "_so"], ["date", "id"], "pos").join(parts, ["site", "top"]).join(sections, ["site", "top", "_so"])
    return numbered.select("site", F.col("part_no").cast("long"), "part_title", "part_slug", F.col("section_no").cast("long"), "section_title", "section_slug", F.col("pos").cast("long"), "url")


def site_entries(posts: DataFrame) -> DataFrame:
    """(url, title, date, seq) of posts with web addresses, in order of id."""
    return clean_posts(posts).where(is_http(F.col("link"))).select(F.col("link").alias("url"), F.lit("").alias("title"), "date", F.col("id").cast("long").alias("seq"))
