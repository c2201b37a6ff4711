"""Title cleaning: a known site's name, or a tail most titles share, is taken from the end."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import or_empty, strip

# Separators before a site's name, and before a shared tail, in their order.
SEPARATORS = [" - ", " – ", " — ", " — ", " | ", " · ", " :: ", "：", " -"]
TAIL_SEPARATORS = [" - ", " – ", " — ", " | ", " · "]
HOME_TAILS = [" - 首页", " | 首页", " - Home", " | Home"]
MIN_SHARE, MIN_COUNT, LONGEST_TAIL = 0.6, 3, 30


def _quoted(c: Column) -> Column:
    """A string as a pattern for itself; NULL if it is empty."""
    return F.when(c != "", F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))


def _cut(title: Column, separators: list[str], names: Column) -> Column:
    """`title` without a separator and a name (a pattern) at its end, if two characters are left; NULL names cut nothing."""
    seps = "|".join(re.escape(s) for s in dict.fromkeys(separators))
    pattern = F.concat(F.lit(f"(?s)^(.{{2,}}?)(?:{seps})(?:"), F.coalesce(names, F.lit("(?!)")), F.lit(")$"))
    return strip(F.regexp_replace(title, pattern, F.lit("$1")))


def strip_site_suffix(title: Column, *names: Column) -> Column:
    """`title` without a separator and one of the names at its end; names count without a home-page tail, too."""
    home = "(?:" + "|".join(re.escape(h) for h in HOME_TAILS) + ")$"
    forms = F.array(*[strip(or_empty(n)) for n in names])
    forms = F.concat(forms, F.transform(forms, lambda n: strip(F.regexp_replace(n, home, ""))))
    alt = F.array_join(F.array_distinct(F.filter(F.transform(forms, _quoted), lambda n: n.isNotNull())), "|")
    return _cut(strip(or_empty(title)), SEPARATORS, F.nullif(alt, F.lit("")))


def _tail(t: Column) -> Column:
    """What follows the last of the first separator that the title holds, if it has 2 to LONGEST_TAIL characters."""
    first = F.coalesce(*[F.when(F.contains(t, F.lit(s)), F.substring_index(t, s, -1)) for s in TAIL_SEPARATORS])
    tail = strip(first)
    return F.when((F.length(t) >= 4) & F.length(tail).between(2, LONGEST_TAIL), tail)


def common_tail(titles: DataFrame, title: str = "title", by: list[str] = (), seq: str = "seq", min_share: float = MIN_SHARE, min_count: int = MIN_COUNT) -> DataFrame:
    """(by..., tail, n): the tail most frequent in each group, the first seen among equals, if enough titles and a large enough share of all have it."""
    t = titles.select(*by, F.col(seq).alias("seq"), strip(or_empty(F.col(title))).alias("t"))
    total = t.groupBy(*by).agg(F.count("*").alias("total"))
    tails = t.withColumn("tail", _tail(F.col("t"))).where("tail IS NOT NULL").groupBy(*by, "tail").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = tails.groupBy(*by).agg(F.max_by(F.struct("tail", "n"), F.struct("n", -F.col("first"))).alias("v")).select(*by, "v.tail", "v.n")
    j = best.join(total, list(by)) if by else best.crossJoin(F.broadcast(total))
    return j.where((F.col("n") >= min_count) & (F.col("n") >= F.col("total") * min_share)).select(*by, "tail", "n")


def strip_common_tail(titles: DataFrame, title: str = "title", by: list[str] = (), seq: str = "seq", out: str = "clean_title") -> DataFrame:
    """`titles` with `out`: the title without its group's common tail."""
    tail = common_tail(titles, title, by, seq).select(*by, F.col("tail").alias("_tail"))
    j = titles.join(tail, list(by), "left") if by else titles.join(F.broadcast(tail), F.lit(True), "left")
    t = strip(or_empty(F.col(title)))
    return j.withColumn(out, _cut(t, TAIL_SEPARATORS, _quoted(F.col("_tail")))).drop("_tail")


def clean_titles(titles: DataFrame, site_name: Column, title: str = "title", by: list[str] = (), seq: str = "seq", out: str = "clean_title") -> DataFrame:
    """Both steps: the known name first, then the tail that is common afterwards."""
    first = titles.withColumn("_t", strip_site_suffix(F.col(title), site_name))
    return strip_common_tail(first, "_t", by, seq, out).drop("_t")
