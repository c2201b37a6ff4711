"""Parent-child rows to full hierarchies: paths, depths, roots, descendants, cycles.

Level-wise frontier joins from the roots extend paths and depths. A join advances the frontier by
up to `UNROLL` levels, because the hops table already holds the descendants 1..UNROLL steps below
each node; the number of rounds is depth / UNROLL. Nodes no frontier reaches lie on a circle or
behind one; repeated visits of pointer jumps among them name the circles.

Nulls: a NULL or 0 parent makes a root; a parent that names no row makes a root marked `orphan`;
rows with a NULL id are left out, since nothing can refer to them. NULL or blank slugs appear in
paths as `#<id>`. Repeated ids count once (the smallest row by value). Empty input gives empty
results. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import fresh_path, written

#: Levels that one join of the frontier advances: with lines, and, as twice doubled, with ids alone.
UNROLL, DOUBLINGS = 4, 2
MAX_ROUNDS = 1_000_000
#: What a frontier carries beside the id: all of a line, or nothing where only reach matters.
LINE, REACH = ("root", "depth", "path", "line"), ()


@dataclass
class Hierarchy:
    """`nodes` one row a category; `lines` the reached ones with their ancestor ids; `cycles` (id, cycle_id). The last two are made when asked for."""

    nodes: DataFrame

    @cached_property
    def lines(self) -> DataFrame:
        return _levels(self.nodes, LINE)

    @cached_property
    def cycles(self) -> DataFrame:
        reached = self.lines if "lines" in self.__dict__ else _levels(self.nodes, REACH)
        unreached = self.nodes.select("id", "parent").join(reached.select("id"), "id", "left_anti")
        return _cycles(written(unreached, "tree-unreached"))

    def paths(self) -> DataFrame:
        """(id, site, parent, state, path, depth, root, cycle_id), one row a node.

        state is 'root', 'orphan', 'child', 'cycle' or 'behind_cycle'; the last two have no path.
        """
        n, p, c = self.nodes, self.lines.drop("line"), self.cycles
        state = (
            F.when(F.col("cycle_id").isNotNull(), "cycle").when(F.col("depth").isNull(), "behind_cycle")
            .when(F.col("depth") > 1, "child").when(F.col("parent") == 0, "root").otherwise("orphan")
        )
        return (
            n.join(p, "id", "left").join(c, "id", "left")
            .select("id", "site", "parent", state.alias("state"), "path", "depth", "root", "cycle_id")
        )

    def descendants(self) -> DataFrame:
        """(ancestor, descendant, distance) for every proper ancestor of every reached node."""
        return (
            self.lines.select("id", F.posexplode(F.reverse("line")).alias("pos", "ancestor"))
            .where("pos > 0").select("ancestor", F.col("id").alias("descendant"), F.col("pos").alias("distance"))
        )

    def n_descendants(self) -> DataFrame:
        """(id, n_descendants); nodes without any are absent."""
        return self.descendants().groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_descendants"))


def clean_nodes(df: DataFrame, id_col: str = "id", parent_col: str = "parent", slug_col: str = "slug", site_col: str = "site") -> DataFrame:
    """One row an id: (id, site, slug, parent), parent 0 for roots."""
    cols = [F.coalesce(F.col(parent_col), F.lit(0)).alias("parent"), F.col(site_col).alias("site"), F.col(slug_col).alias("slug")]
    slug = F.coalesce(F.nullif(F.trim("v.slug"), F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))
    return (
        df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(*cols)).alias("v"))
        .select("id", "v.site", slug.alias("slug"), "v.parent")
    )


def build(df: DataFrame, id_col: str = "id", parent_col: str = "parent", slug_col: str = "slug", site_col: str = "site") -> Hierarchy:
    """Resolve the whole forest of `df`."""
    return Hierarchy(written(clean_nodes(df, id_col, parent_col, slug_col, site_col), "tree-nodes"))


def _hops(nodes: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(top, id, step), and slugs, ids where lines are carried: id lies step levels below top, 1 <= step <= UNROLL, or twice as often doubled."""
    more = [F.array("slug").alias("slugs"), F.array("id").alias("ids")] if carry else []
    step = nodes.where("parent <> 0").select(F.col("parent").alias("top"), "id", F.lit(1).alias("step"), *more)
    parts = [step]
    for k in range(2, UNROLL + 1):
        below = nodes.select(F.col("id").alias("c"), F.col("parent").alias("id"), F.col("slug").alias("s"))
        grown = [F.concat("slugs", F.array("s")).alias("slugs"), F.concat("ids", F.array("c")).alias("ids")] if carry else []
        step = step.join(below, "id").select("top", F.col("c").alias("id"), F.lit(k).alias("step"), *grown)
        # ids alone are cheap to join again
        step = written(step, "tree-hops") if carry and k < UNROLL else step
        parts.append(step)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = written(out, "tree-hops")
    for k in range(0 if carry else DOUBLINGS):
        most = UNROLL << k
        on = out.where(F.col("step") == most).select("top", F.col("id").alias("mid"))
        over = out.select(F.col("top").alias("mid"), "id", (F.col("step") + most).alias("step"))
        out = written(out.unionByName(on.join(over, "mid").select("top", "id", "step")), "tree-hops")
    return out


def _levels(nodes: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(id, carry...) of every node that a root reaches; line holds the ids from the root down.

    A frontier row meets all nodes up to UNROLL levels below it, or UNROLL << DOUBLINGS where ids are all it carries. Ids are unique in the frontier, so a
    parent with very many children is skew on one side alone, which Spark splits.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col("id").alias("parent"))
    roots = nodes.where("parent = 0").unionByName(nodes.where("parent <> 0").join(known, "parent", "left_anti").select(nodes.columns))
    begin = {"root": F.col("id"), "depth": F.lit(1), "path": F.col("slug"), "line": F.array("id")}
    hops = _hops(nodes, carry)
    frontier = written(roots.select("id", *[begin[c].alias(c) for c in carry]), "tree-level")
    further = {"root": F.col("root"), "depth": F.col("depth") + F.col("step"), "path": F.concat_ws("/", "path", F.concat_ws("/", "slugs")) if carry else F.lit(""), "line": F.concat("line", "ids") if carry else F.lit("")}
    parts, most = [frontier], UNROLL if carry else UNROLL << DOUBLINGS
    for _ in range(MAX_ROUNDS):
        below = frontier.withColumnRenamed("id", "top").join(hops, "top").select("id", *[further[c].alias(c) for c in carry], "step")
        path = fresh_path(spark, "tree-level")
        below.write.partitionBy("step").parquet(path)
        level = spark.read.schema(below.schema).parquet(path)
        frontier = level.where(F.col("step") == most).drop("step")
        parts.append(level.drop("step"))
        if frontier.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cycles(left: DataFrame) -> DataFrame:
    """(id, cycle_id) of the nodes of `left` (id, parent; every parent is in it) that reach themselves.

    Each step doubles the jump of every node and the stretch its minimum covers; a round takes two. The
    images of the jumps shrink to the circles; once their number and all minima on them stand still, the
    images are the circles and each minimum is the smallest id of its circle.
    """
    jumps = left.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low"))

    def doubled(j: DataFrame) -> DataFrame:
        far = j.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        return j.join(far, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"))

    before = None
    while True:
        images = jumps.select(F.col("to").alias("id")).distinct()
        on = images.join(jumps, "id").select("id", F.col("low").alias("cycle_id"))
        now = on.agg(F.count("*"), F.sum(F.xxhash64("id", "cycle_id").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return on
        before = now
        jumps = written(doubled(doubled(jumps)), "tree-jumps")
