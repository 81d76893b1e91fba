"""Joins that no hot key can slow down."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in ``HOT`` of all rows is joined by broadcast; fewer than ``HOT`` keys can have so many.
HOT = 1000


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of rows with one row for each key, whose column ``n`` holds the key's number of rows.

    Hot keys, fewer than ``HOT`` by their counts, are broadcast; the others are shuffled, none with more than one in ``HOT``
    of the rows.  ``groups`` should be a written table: it is read several times.  Keys aren't null.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = groups.where(F.col(n) > total / HOT)
    warm = rows.join(F.broadcast(hot), on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(n) <= total / HOT), on)
    return warm.unionByName(cold)
