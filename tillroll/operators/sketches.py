"""Mergeable sketches of distinct counts and quantiles (A7; F5, A13, A14).

A sketch is made for each part of the input (a month's lines, a segment's rows) and kept; any set of parts is answered by merging
their sketches, without the rows.  Exact forms stay the default elsewhere (``clean``, ``quantiles``); these are for
counts and quantiles over parts that were read before.  Nulls are in no sketch; a group without values has no row.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of a distinct sketch's registers, and entries of a quantile sketch's level.
LG_REGISTERS, LEVEL = 14, 1024
#: Relative error of a merged distinct count (four standard errors) and rank error of a quantile.
DISTINCT_ERROR = 4 * 1.04 / math.sqrt(1 << LG_REGISTERS)
RANK_ERROR = 0.01


def distinct_sketches(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    """part, metric, sketch: one HyperLogLog sketch for each part and column, in one aggregation."""
    made = df.groupBy(part.alias("part")).agg(*[F.hll_sketch_agg(c, LG_REGISTERS).alias(c) for c in columns])
    return made.select("part", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("sketch")) for c in columns])).alias("s")).select("part", "s.*")


def merged_distinct(sketches: DataFrame, keys: list[Column]) -> DataFrame:
    """keys, metric, estimate: distinct counts over all parts of a key."""
    return sketches.groupBy(*keys, "metric").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def checked_distinct(df: DataFrame, sketches: DataFrame, key: Column, part_key: Column, columns: list[str]) -> DataFrame:
    """key, metric, exact_count, within_error: the merged counts held against exact ones over ``df``."""
    values = df.select(key.alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select("key", "s.*")
    exact = values.where("v is not null").distinct().groupBy("key", "metric").agg(F.count(F.lit(1)).alias("exact_count"))
    close = F.abs(F.col("estimate") - F.col("exact_count")) <= F.lit(DISTINCT_ERROR) * F.col("exact_count")
    return exact.join(merged_distinct(sketches, [part_key.alias("key")]), ["key", "metric"]).select("key", "metric", "exact_count", close.alias("within_error"))


def quantile_sketches(long: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, sketch: one KLL sketch for each key of an unpivoted table."""
    return long.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(value, F.lit(LEVEL)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """keys, n, q, value: quantiles over all sketches of a key."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    got = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in qs]))
    return merged.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), got.alias("s")).select(*keys, "n", "s.*")


def checked_quantiles(long: DataFrame, quantiles: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, q, n, within_error: is the share of rows below (or up to) each value the quantile's, but for ``RANK_ERROR``?

    ``quantiles`` has a row for each key and quantile, a bounded few; each row of ``long`` is counted once a quantile, partially first."""
    ranks = long.where(F.col(value).isNotNull()).join(F.broadcast(quantiles.select(*keys, "q", "n", F.col("value").alias("_at"))), keys)
    ranks = ranks.groupBy(*keys, "q", "n").agg(F.count_if(F.col(value) < F.col("_at")).alias("below"), F.count_if(F.col(value) <= F.col("_at")).alias("upto"))
    close = (F.col("below") / F.col("n") <= F.col("q") + RANK_ERROR) & (F.col("upto") / F.col("n") >= F.col("q") - RANK_ERROR)
    return ranks.select(*keys, "q", "n", close.alias("within_error"))
