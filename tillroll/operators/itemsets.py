"""Frequent itemsets (M8): level-wise Apriori on DataFrames, and FPGrowth.

Level-wise plan (lengths 1..max_len):

1. level 1 = item counts over the distinct ``(basket, item)`` pairs;
2. every basket becomes one row with its sorted frequent items, written once;
3. level k+1 extends every frequent k-itemset found in a basket's row by the
   items that follow it (items are sorted, so each itemset is generated once),
   counts each candidate (partial aggregation before the shuffle) and keeps those
   with ``freq / N >= min_support``; each level is written.

Candidate rows never leave their basket's row: infrequent ones are dropped by a semi
join with the level's frequent itemsets, whose number is known once they are written.  Up to
``BROADCAST_ITEMSETS`` they are broadcast; more than that (a support far below use) are joined by key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import materialize

ITEMSET_COLS = ["items", "freq", "support", "length"]


def _finish(df: DataFrame, n_baskets: int) -> DataFrame:
    return df.select(
        "items", "freq",
        (F.col("freq") / F.lit(n_baskets)).alias("support"),
        F.size("items").alias("length"),
    )


#: Itemsets of one level that may be broadcast (tens of MB).
BROADCAST_ITEMSETS = 200_000


def _only(rows: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in a written table of frequent items or itemsets."""
    small = frequent.count() <= BROADCAST_ITEMSETS
    return rows.join(F.broadcast(frequent) if small else frequent, key, "left_semi")


def _extended(rows: DataFrame) -> DataFrame:
    """(items, itemset, pos) -> every extension by an item after ``pos``."""
    return rows.select("items", "itemset", "pos", F.posexplode(F.slice("items", F.col("pos") + 2, F.size("items"))).alias("off", "item")).select(
        "items", F.concat("itemset", F.array("item")).alias("itemset"), (F.col("pos") + 1 + F.col("off")).alias("pos"))


def frequent_itemsets(pairs: DataFrame, n_baskets: int, min_support: float,
                      max_len: int = 3) -> DataFrame:
    """``pairs``: distinct ``(basket, item)``; returns ``items, freq, support, length`` (written once)."""
    if n_baskets <= 0:
        return _finish(pairs.sparkSession.createDataFrame([], "items array<string>, freq bigint"), 1)
    frequent = (F.col("freq") / F.lit(n_baskets)) >= F.lit(min_support)

    l1 = materialize(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).filter(frequent))
    levels = [l1.select(F.array("item").alias("items"), "freq")]
    if max_len >= 2:
        baskets = materialize(_only(pairs, l1.select("item"), "item")
                              .groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
                              .filter(F.size("items") > 1).select("items"))
        rows = baskets.select("items", F.posexplode("items").alias("pos", "item")).select("items", F.array("item").alias("itemset"), "pos")
        for k in range(2, max_len + 1):
            rows = _extended(rows)
            counts = materialize(rows.groupBy("itemset").agg(F.count(F.lit(1)).alias("freq")).filter(frequent))
            levels.append(counts.select(F.col("itemset").alias("items"), "freq"))
            if k < max_len:
                rows = _only(rows, counts.select("itemset"), "itemset")
    out = levels[0]
    for lvl in levels[1:]:
        out = out.unionByName(lvl)
    return materialize(_finish(out, n_baskets))


def frequent_itemsets_fpgrowth(arrays: DataFrame, min_support: float, max_len: int = 3) -> DataFrame:
    """Second engine: ``pyspark.ml.fpm.FPGrowth`` over one array per basket
    (empty arrays included, they count in N); FPGrowth has no length limit,
    so longer itemsets are filtered afterwards.  It is the cross-check engine:
    parallel FP-growth sends all conditional transactions of an item group to
    one task, so the level-wise engine above is the default."""
    from pyspark.ml.fpm import FPGrowth

    n = arrays.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(arrays)
    fi = model.freqItemsets.filter(F.size("items") <= max_len)
    return _finish(fi.select(F.array_sort("items").alias("items"), "freq"), n)
