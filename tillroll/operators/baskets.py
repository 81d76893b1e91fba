"""Basket build (M7, A3, A5, F7, O3, J5) in long form — never a wide 0/1 matrix.

``(basket, item)`` pairs come from one aggregation keyed by the pair
(quantity summed, kept when positive).  A caller may limit items to those bought
in at least ``min_count`` baskets and, of these, the ``max_items`` most
frequent ones (ties by item); by default no item is dropped, since mining drops
infrequent items anyway.

Every cleaned basket stays in the support denominator, also when none of its
items survive the item filter.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import dealt, materialize


@dataclass(frozen=True)
class BasketSpec:
    basket_col: str = "InvoiceNo"
    item_col: str = "Description"
    min_count: int = 1  # F7 and O3 are off unless a caller asks for them
    max_items: int | None = None


def basket_pairs(clean_basket: DataFrame, spec: BasketSpec) -> DataFrame:
    """Distinct ``(basket, item)`` with positive summed quantity (null keys dropped)."""
    lines = (clean_basket
             .filter(F.col(spec.basket_col).isNotNull() & F.col(spec.item_col).isNotNull())
             .select(F.col(spec.basket_col).alias("basket"), F.col(spec.item_col).alias("item"), "Quantity"))
    return (dealt(lines, ["basket"], ["item"])
            .groupBy("basket", "_part", "item")
            .agg(F.sum("Quantity").alias("qty"))
            .filter(F.col("qty") > 0)
            .select("basket", "item"))


def item_frequency(pairs: DataFrame) -> DataFrame:
    """A5: number of baskets per item."""
    return pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n_baskets"))


def kept_items(pairs: DataFrame, spec: BasketSpec) -> DataFrame:
    """F7 + O3: items in >= min_count baskets and, if asked for, the top ``max_items`` by frequency."""
    kept = item_frequency(pairs).filter(F.col("n_baskets") >= spec.min_count)
    if spec.max_items is None:
        return kept
    return kept.orderBy(F.desc("n_baskets"), F.asc("item")).limit(spec.max_items)


def limited(pairs: DataFrame, spec: BasketSpec) -> DataFrame:
    """Pairs of the kept items.  A top-k list is bounded by ``max_items`` and broadcast; a
    count limit alone is a join that Spark sizes itself."""
    if spec.max_items is None and spec.min_count <= 1:
        return pairs
    keep = kept_items(pairs, spec).select("item")
    keep = keep if spec.max_items is None else F.broadcast(keep)
    return pairs.join(keep, "item", "left_semi").select("basket", "item")


def basket_items(clean_basket: DataFrame, spec: BasketSpec) -> DataFrame:
    return limited(basket_pairs(clean_basket, spec), spec)


def basket_arrays(clean_basket: DataFrame, spec: BasketSpec) -> DataFrame:
    """One row per cleaned basket with its sorted kept items (empty array when
    none survive) — the input shape of ``FPGrowth``."""
    items = (basket_items(clean_basket, spec).groupBy("basket")
             .agg(F.array_sort(F.collect_list("item")).alias("items")))
    all_baskets = (clean_basket.filter(F.col(spec.basket_col).isNotNull())
                   .select(F.col(spec.basket_col).alias("basket")).distinct())
    return (all_baskets.join(items, "basket", "left")
            .select("basket", F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def prepare(clean_basket: DataFrame, spec: BasketSpec) -> tuple[DataFrame, int]:
    """Pairs of the kept items, and the support denominator, from
    one pass over the cleaned lines: the distinct pairs are written once and
    both the basket count and the item statistics read them.  (Cleaned lines
    have positive quantities, so every cleaned basket has at least one pair.)"""
    pairs = materialize(basket_pairs(clean_basket, spec))
    n = pairs.select(F.count_distinct("basket")).first()[0]
    return limited(pairs, spec), n
