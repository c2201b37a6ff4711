"""Mixing sources to target weights.

Hash-threshold histograms: the tokens of each source are summed by buckets of its documents' hashes.
A source's budget is so many whole copies of it and a rest; the rest is met by the documents below a
hash threshold. The histogram gives the bucket in which the threshold lies, and only that bucket is
refined, by the next bits of the hash, until it is settled. Documents are then taken by comparing
hashes, without sorting. Budgets are nested: a smaller one takes a subset of a larger one's documents.

The total is the greatest that every source can meet at its share within its repeats, or the one
given, if that is smaller. A source of `targets` without documents can't contribute; its share is
spread over the others in proportion and reported as 0.

Names of sources are compared without case, blanks and the kind of separator. Documents of other or
NULL sources take no part. NULL texts have no tokens; documents without tokens are taken like others.
Only sums per source and bucket reach the driver, at most SOURCES x 2^BITS rows at a time; more
sources than that are worked off in turns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import small, written

#: Bits of the hash a histogram resolves at once, and the sources whose histograms the driver holds at a time.
BITS, SOURCES = 9, 1000
_LOW = -(1 << 63)


def source_name(c) -> F.Column:
    """One spelling of a source's name; NULL for blank ones."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "-"), F.lit(""))


@dataclass
class Plan:
    """For each source: whole copies, the hash below which one more is due, and the budget."""

    copies: dict[str, int]
    below: dict[str, int]
    budget: dict[str, float]
    available: dict[str, int]


def _sums(sizes: DataFrame, shift: int) -> dict[str, dict[int, int]]:
    """Tokens by source and bucket of the hash."""
    out: dict[str, dict[int, int]] = {}
    for r in sizes.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("t")).collect():
        out.setdefault(r.source, {})[r.b] = r.t
    return out


def thresholds(sizes: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """For each source the hash below which its documents hold about `rest` tokens; only the bucket it lies in is refined."""
    rest, below, shift = dict(rest), dict.fromkeys(rest, _LOW), 64 - BITS
    todo = {s for s in rest if rest[s] > 0}
    level = _sums(sizes, shift) if todo else {}
    while todo:
        edge: dict[str, int] = {}
        for s in todo:
            for b in sorted(level.get(s, {})):
                t = level[s][b]
                if t <= rest[s]:
                    rest[s] -= t
                    below[s] = (b + 1) << shift
                else:
                    # at one hash a bucket, take the document if that is nearer to the budget
                    if shift == 0:
                        below[s] = (b + 1) << shift if rest[s] * 2 >= t else below[s]
                    elif rest[s] > 0:
                        edge[s] = b
                    break
        if not edge:
            break
        at = F.lit(False)
        for s, b in edge.items():
            at = at | ((F.col("source") == s) & (F.col("h") >= (b << shift)) & (F.col("h") <= ((b + 1) << shift) - 1))
            below[s] = b << shift
        shift = max(0, shift - BITS)
        level = _sums(sizes.where(at), shift)
        todo = set(edge)
    return below


def plan(sizes: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, at_once: int = SOURCES) -> Plan:
    """Budgets and thresholds for `sizes` (source, h, tokens)."""
    available = dict.fromkeys(targets, 0) | {r.source: r.t for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    live = {s: v for s, v in targets.items() if available[s] > 0 and v[0] and v[1]}
    whole = sum(v[0] for v in live.values())
    share = {s: v[0] / whole for s, v in live.items()}
    most = min((live[s][1] * available[s] / share[s] for s in live), default=0.0)
    most = min(most, total) if total is not None else most
    budget = {s: share[s] * most for s in live}
    copies = {s: min(live[s][1], int(budget[s] / available[s] + 1e-9)) for s in live}
    rest = {s: max(0.0, budget[s] - copies[s] * available[s]) if copies[s] < live[s][1] else 0.0 for s in live}
    below: dict[str, int] = {}
    names = sorted(live)
    for i in range(0, len(names), at_once):
        turn = names[i : i + at_once]
        below |= thresholds(sizes if len(names) <= at_once else sizes.where(F.col("source").isin(*turn)), {s: rest[s] for s in turn})
    return Plan(copies, below, budget, available)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", total: float | None = None, at_once: int = SOURCES) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). `targets` are parameters; the driver reads them.

    chosen: (key, source, tokens, copies), copies > 0. shares: (source, target_share, available,
    used, actual_share, times) for every source of `targets`; times is the largest number of copies.
    """
    wanted = {r.s: (r.w, r.m) for r in targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").alias("w"), F.col("max_repeats").alias("m")).where("s IS NOT NULL").collect()}
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    sizes = docs.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens")).join(small(names), "source", "left_semi")
    sizes = written(sizes.distinct().withColumn("h", F.xxhash64("key")), "mix-sizes")
    p = plan(sizes, wanted, total, at_once)
    rows = [(s, p.copies[s], p.below[s] - 1 if p.below[s] > _LOW else None) for s in p.copies]
    per = spark.createDataFrame(rows, "source string, n int, upto long")
    copies = F.col("n") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)
    chosen = sizes.join(small(per), "source").withColumn("copies", copies.cast("int")).where("copies > 0").select(F.col("key").alias(key), "source", "tokens", "copies")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("times"))
    goal = spark.createDataFrame([(s, float(w or 0), int(p.available.get(s, 0))) for s, (w, _) in wanted.items()], "source string, target_share double, available long")
    whole = used.agg(F.sum("used").alias("whole"))
    shares = (
        goal.join(used, "source", "left").crossJoin(F.broadcast(whole)).na.fill(0, ["used", "times"])
        .select("source", "target_share", "available", "used", F.coalesce(F.col("used") / F.nullif(F.col("whole"), F.lit(0)), F.lit(0.0)).alias("actual_share"), "times")
    )
    return chosen, shares
