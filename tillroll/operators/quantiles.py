"""Exact, distributed quantiles per group (used by F5, A13, A14).

Spark's exact ``percentile`` keeps every distinct value of a group in one
in-memory map that is merged in a single task, so one large group (all
products for a global cap, a segment holding a third of all customers) ends up
in one buffer.  Here a group is never gathered:

1. distinct values with their multiplicity (hash aggregation, partial per
   partition — a value repeated millions of times becomes one row);
2. a range partition of ``(group, value)``: a large group spans many
   partitions in value order (boundaries come from sampling, so it stays
   balanced); the table is written once so both uses below see the same
   partitioning;
3. per (group, partition) block counts — a table of at most groups x
   partitions rows — give each block's rank range;
4. the ranks a quantile needs (``floor``/``ceil`` of ``q * (n - 1)``) are looked
   up inside the few blocks that hold them, with a running count over that
   block's values only.

Interpolation is the same as Spark's ``percentile`` (linear between the two
neighbouring ranks, pandas/numpy "linear").
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import materialize


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """One row per group and quantile: ``keys..., q, value`` (nulls ignored;
    groups without values are absent).  The same plan at every size."""
    if not keys:  # one global group: an internal constant key
        return exact_quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value, qs).drop("_g")
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    ranged = materialize(counted.repartitionByRange(*keys, "_v").withColumn("_pid", F.spark_partition_id()))
    return _select(ranged, keys, qs)


def _select(ranged: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    by_group = Window.partitionBy(*keys)
    blocks = (ranged.groupBy(*keys, "_pid").agg(F.sum("_m").alias("_cnt"))
              .withColumn("_end", F.sum("_cnt").over(by_group.orderBy("_pid")
                                                     .rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_n", F.sum("_cnt").over(by_group))
              .withColumn("_start", F.col("_end") - F.col("_cnt")))
    sizes = blocks.select(*keys, "_n").distinct()
    pos = F.col("_q") * (F.col("_n") - 1)
    targets = (sizes.select(*keys, "_n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("_q"))
               .withColumn("_pos", pos)
               .withColumn("_lo", F.floor("_pos"))
               .withColumn("_hi", F.ceil("_pos")))
    ranks = targets.select(*keys, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_r")).distinct()
    located = ranks.join(blocks.select(*keys, "_pid", "_start", "_end"), keys) \
                   .filter((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_end")))
    need = located.select(*keys, "_pid").distinct()
    inside = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = (ranged.join(need, [*keys, "_pid"], "left_semi")
            .withColumn("_cum", F.sum("_m").over(inside)))
    at_rank = (cand.join(located, [*keys, "_pid"])
               .filter((F.col("_start") + F.col("_cum") - F.col("_m") <= F.col("_r"))
                       & (F.col("_r") < F.col("_start") + F.col("_cum")))
               .select(*keys, "_r", "_v"))
    lo = at_rank.withColumnsRenamed({"_r": "_lo", "_v": "_vlo"})
    hi = at_rank.withColumnsRenamed({"_r": "_hi", "_v": "_vhi"})
    out = targets.join(lo, [*keys, "_lo"]).join(hi, [*keys, "_hi"])
    interp = (F.col("_hi") - F.col("_pos")) * F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * F.col("_vhi")
    val = (F.when(F.col("_hi") == F.col("_lo"), F.col("_vlo"))
            .when(F.col("_vhi") == F.col("_vlo"), F.col("_vlo"))
            .otherwise(interp))
    return out.select(*keys, F.col("_q").alias("q"), val.alias("value"))


def quantile_columns(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """Wide form: one row per group, one column per named quantile."""
    q = exact_quantiles(df, keys, value, list(named.values()))
    aggs = [F.max(F.when(F.col("q") == F.lit(float(v)), F.col("value"))).alias(n) for n, v in named.items()]
    if keys:
        return q.groupBy(*keys).agg(*aggs)
    return q.agg(*aggs)
