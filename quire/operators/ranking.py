"""Row numbers that don't gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import small, written

#: Rows that one window may number, a bound on what a task sorts.
FEW = 100_000
Key = Column | str | tuple


def _key(o: Key) -> tuple[Column, bool]:
    c, down = (o[0], o[1] == "desc") if isinstance(o, tuple) else (o, False)
    return (F.col(c) if isinstance(c, str) else c), down


def _directed(c: Column, down: bool) -> Column:
    return c.desc_nulls_last() if down else c.asc_nulls_first()


def row_numbers(df: DataFrame, by: list[str], order: list[Key], out: str = "rn", few: int = FEW) -> DataFrame:
    """`df` with the number of each row, from 1, within equal `by` columns in the `order`.

    The rows are written once. At most `few` of them are numbered by a window. More are range-partitioned
    by group and order, so a hot group spreads over many partitions, sorted inside them and written with
    their place; a row's number is its place among its group's rows of the partition, moved by the counts
    of the partitions before. There is no second shuffle of the rows unless groups are too many to broadcast.

    A key of `order` is a column, or (column, "desc"). `order` should be total; ties are numbered in no
    particular order. NULL groups are a group like others. An empty `by` numbers the whole table.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keys = [_key(o) for o in order]
    sort = [_directed(F.col(n), down) for (_, down), n in zip(keys, names)]
    rows = written(df.select("*", *[c.alias(n) for (c, _), n in zip(keys, names)]), "unnumbered")
    if rows.count() <= few:
        return rows.select(*[F.col(c) for c in df.columns], F.row_number().over(W.partitionBy(*by).orderBy(*sort)).cast("long").alias(out))
    ranges = [F.col(b).asc_nulls_first() for b in by] + sort
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    part = written(rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges).select(*df.columns, F.spark_partition_id().alias("_p"), place.alias("_i")), "ranges")
    # one row a group and partition: a small table, whatever the size of a group
    counts = part.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    a, b = part.alias("a"), small(offsets).alias("b")
    same = F.col("a._p") == F.col("b._p")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b._before") + F.col("a._i") - F.col("b._first") + 1).alias(out))
