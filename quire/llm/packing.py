"""Filling fixed-capacity containers with items.

Best-two-fit: a container is filled greedily with the largest items that fit; then its smallest
item gives way to two unpacked items, if some pair fits the expanded gap more tightly. An item
larger than the capacity is cut at multiples of the capacity; its full pieces are containers of
their own and the rest is packed like any item. No other item is cut.

Items are spread over groups by a hash of their id, about `group_items` each, and every group is
packed by itself: only a group's last container has room for want of items, so the space lost falls
with the group size and not with the number of groups. A hot id can't exist, as ids are unique.

Nulls: a NULL text has no tokens; items without tokens go into the first container of their group.
A profile with a NULL or non-positive capacity packs nothing. Items with a NULL key are left out.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import small

GROUP_ITEMS = 8192


class _Sizes:
    """The unpacked items by size: distinct sizes in order, and the items of each."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            self.items.setdefault(s, []).append(i)
        self.keys = sorted(self.items)

    def take(self, s: int) -> int:
        got = self.items[s]
        i = got.pop()
        if not got:
            del self.items[s]
            self.keys.pop(bisect_right(self.keys, s) - 1)
        return i

    def give(self, s: int, i: int) -> None:
        if s not in self.items:
            self.keys.insert(bisect_right(self.keys, s), s)
            self.items[s] = []
        self.items[s].append(i)

    def largest(self, room: int) -> int | None:
        k = bisect_right(self.keys, room)
        return self.keys[k - 1] if k else None

    def best_two(self, room: int) -> tuple[int, int] | None:
        """The sizes a >= b of two unpacked items with the greatest sum of at most `room`."""
        k = bisect_right(self.keys, room - 1)
        if not k:
            return None
        keys = np.array(self.keys[:k], dtype=np.int64)
        at = np.searchsorted(keys, np.minimum(room - keys, keys), side="right") - 1
        # a partner of the same size needs a second item of that size
        same = (at >= 0) & (keys[at] == keys)
        single = same & np.array([len(self.items[x]) < 2 if y else False for x, y in zip(self.keys, same)])
        at = np.where(single, at - 1, at)
        total = np.where(at >= 0, keys + keys[np.maximum(at, 0)], -1)
        best = int(total.argmax())
        return (int(keys[best]), int(keys[at[best]])) if total[best] > 0 else None


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers; every size is between 1 and `capacity`."""
    left = _Sizes(sizes)
    out: list[list[int]] = []
    while left.keys:
        room, mine = capacity, []
        while room and (s := left.largest(room)) is not None:
            mine.append((s, left.take(s)))
            room -= s
        if room and left.keys:
            s, i = mine[-1]  # the smallest, as the largest go first
            two = left.best_two(room + s)
            if two and sum(two) > s:
                mine.pop()
                mine += [(x, left.take(x)) for x in two]
                left.give(s, i)
        out.append([i for _, i in mine])
    return out


def pack(items: DataFrame, profiles: DataFrame, key: str, size: str, capacity: str = "capacity_tokens", profile: str = "profile", group_items: int = GROUP_ITEMS) -> DataFrame:
    """(profile, container, key, piece_no, start, size): where each item, or piece of it, goes.

    `items` has unique keys and sizes; `start` is the piece's offset in the item. Container numbers
    are unique within a profile.
    """
    items = items.where(F.col(key).isNotNull())
    n = items.count()
    groups = max(1, round(n / group_items))
    # profiles are parameters: each item names all of them, without a join
    limits = profiles.select(F.col(profile).alias("profile"), F.col(capacity).cast("long").alias("capacity")).where("capacity > 0").distinct().orderBy("profile", "capacity").collect()
    each = F.array(*[F.struct(F.lit(r.profile).alias("profile"), F.lit(r.capacity).alias("capacity")) for r in limits]) if limits else F.array().cast("array<struct<profile:string,capacity:bigint>>")
    rows = items.select(
        F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), F.pmod(F.xxhash64(F.col(key)), F.lit(groups)).alias("grp"), F.inline(each)
    )
    kind = rows.schema["key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, grp, name = int(pdf["capacity"].iloc[0]), int(pdf["grp"].iloc[0]), pdf["profile"].iloc[0]
        pdf = pdf.sort_values("key", kind="stable")
        keys, sizes = pdf["key"].tolist(), pdf["size"].tolist()
        full: list[tuple] = []
        rest: list[tuple[int, int, int]] = []  # item, piece number, start
        empty: list[int] = []
        for i, s in enumerate(sizes):
            k = s // cap if s > cap else 0
            full += [(i, p + 1, p * cap, cap) for p in range(k)]
            if s == 0:
                empty.append(i)
            elif s - k * cap:
                rest.append((i, k + 1, k * cap))
        bins = best_two_fit([sizes[i] - a for i, _, a in rest], cap)
        out, base = [], grp << 32
        for b, members in enumerate(bins):
            out += [(name, base + b, keys[i], p, a, sizes[i] - a) for i, p, a in (rest[m] for m in members)]
        base += len(bins)
        out += [(name, base + b, keys[i], p, a, s) for b, (i, p, a, s) in enumerate(full)]
        out += [(name, grp << 32, keys[i], 1, 0, 0) for i in empty]
        return pd.DataFrame(out, columns=["profile", "container", "key", "piece_no", "start", "size"])

    packed = rows.groupBy("profile", "grp").applyInPandas(run, f"profile string, container long, key {kind}, piece_no int, start long, size long")
    return packed.withColumnRenamed("key", key).withColumnRenamed("profile", profile)


def report(packed: DataFrame, profiles: DataFrame, capacity: str = "capacity_tokens", profile: str = "profile") -> DataFrame:
    """(profile, containers, used, unused_share)."""
    return (
        packed.groupBy(profile).agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("used"))
        .join(small(profiles.select(profile, capacity).distinct(), 1000), profile)
        .select(profile, "containers", "used", (1 - F.col("used") / (F.col("containers") * F.col(capacity))).alias("unused_share"))
    )

