"""Feature builders: RFM per customer (M1), product features (M2), describe.

Both builders are a single hash aggregation keyed by the entity.  A customer or product that owns a
large share of all lines is dealt over ``DEAL_PARTS`` tasks first, and contributes one partial row each.
The global scalars (reference date, revenue cap) are scalar subqueries that
Spark evaluates once and inlines — no cross join — over the checkpointed
per-entity table, so the lines are aggregated only once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import whole_days
from tillroll.operators.quantiles import quantile_columns
from tillroll.session import dealt, materialize

RFM_FEATURES = ["Recency", "Frequency", "Monetary"]
PRODUCT_FEATURES = ["avg_price", "total_quantity", "num_transactions", "num_customers", "total_revenue"]


def build_rfm(clean_rfm: DataFrame) -> DataFrame:
    """CustomerID, Frequency (distinct invoices), Monetary, Recency (whole days
    before max(InvoiceDate) + 1 day).

    The per-customer aggregate is checkpointed once; the reference date (a
    scalar subquery) and the output both read it instead of scanning and
    joining the lines twice."""
    return _rfm(clean_rfm.groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("LastPurchase"),
        F.count_distinct("InvoiceNo").alias("Frequency"),
        F.sum("TotalPrice").cast("double").alias("Monetary"),
    ))


def rfm_partials(clean_rfm: DataFrame) -> DataFrame:
    """What A1 needs of some of the lines: (CustomerID, InvoiceNo, last, amount); partials of several parts merge to those of all."""
    return clean_rfm.groupBy("CustomerID", "InvoiceNo").agg(F.max("InvoiceDate").alias("last"), F.sum("TotalPrice").alias("amount"))


def merged_rfm_partials(partials: DataFrame) -> DataFrame:
    amount = F.sum("amount").cast(partials.schema["amount"].dataType).alias("amount")
    return dealt(partials, ["CustomerID"], ["InvoiceNo"]).groupBy("CustomerID", "_part", "InvoiceNo").agg(F.max("last").alias("last"), amount).drop("_part")


def rfm_of_partials(partials: DataFrame) -> DataFrame:
    """``build_rfm`` from partials: an invoice whose lines lie in several parts counts once."""
    return _rfm(merged_rfm_partials(partials).groupBy("CustomerID").agg(
        F.max("last").alias("LastPurchase"), F.count("InvoiceNo").alias("Frequency"), F.sum("amount").cast("double").alias("Monetary")))


def _rfm(per_customer: DataFrame) -> DataFrame:
    per_customer = materialize(per_customer)
    ref_date = per_customer.select(F.max("LastPurchase")).scalar() + F.expr("INTERVAL 1 DAY")
    return per_customer.select(
        "CustomerID", "Frequency", "Monetary",
        whole_days(ref_date, F.col("LastPurchase")).alias("Recency"),
    )


def reference_date(clean_rfm: DataFrame) -> DataFrame:
    """Last clean invoice time, the reference time one day later
    and its calendar date (what the RFM job reports)."""
    last = F.max("InvoiceDate")
    ref = last + F.expr("INTERVAL 1 DAY")
    return clean_rfm.agg(last.alias("last_invoice"), ref.alias("reference_time"),
                         F.to_date(ref).alias("reference_date"))


def product_aggregates(clean_product: DataFrame) -> DataFrame:
    """A2: per-Description features before the outlier and activity filters."""
    return _product_totals(product_partials(clean_product))


def product_partials(clean_product: DataFrame) -> DataFrame:
    """What A2 needs of some of the lines: sums by (Description, tag, key); partials of several parts merge to those of all.

    The two distinct counts share one shuffle: a line gives a row keyed by its invoice (with the
    sums) and one keyed by its customer; equal keys merge before they are counted.
    A product is rarely twice on an invoice, so rows are dealt by their keys as they are, without a partial aggregation.
    """
    zero = lambda c: F.lit(None).cast(clean_product.schema[c].dataType)
    by_invoice = F.struct(F.lit("i").alias("tag"), F.col("InvoiceNo").alias("key"), "UnitPrice", "Quantity", "TotalRevenue")
    by_customer = F.struct(F.lit("c").alias("tag"), F.col("CustomerID").alias("key"), zero("UnitPrice").alias("UnitPrice"),
                           zero("Quantity").alias("Quantity"), zero("TotalRevenue").alias("TotalRevenue"))
    tagged = clean_product.select("Description", F.explode(F.array(by_invoice, by_customer)).alias("r")).select("Description", "r.*")
    return dealt(tagged, ["Description"], ["tag", "key"]).groupBy("Description", "_part", "tag", "key").agg(
        F.sum("UnitPrice").alias("price"), F.count("UnitPrice").alias("prices"), F.sum("Quantity").alias("quantity"),
        F.sum("TotalRevenue").alias("revenue")).drop("_part")


def merged_product_partials(partials: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast(partials.schema[c].dataType).alias(c) for c in ("price", "prices", "quantity", "revenue")]
    return dealt(partials, ["Description"], ["tag", "key"]).groupBy("Description", "_part", "tag", "key").agg(*sums).drop("_part")


def _product_totals(merged: DataFrame) -> DataFrame:
    present = F.col("key").isNotNull()
    return merged.groupBy("Description").agg(
        (F.sum("price").cast("double") / F.sum("prices")).alias("avg_price"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        F.count_if((F.col("tag") == "i") & present).alias("num_transactions"),
        F.count_if((F.col("tag") == "c") & present).alias("num_customers"),
        F.sum("revenue").cast("double").alias("total_revenue"),
    )


def build_product_features(clean_product: DataFrame, revenue_quantile: float = 0.99,
                           min_transactions: int = 10, exact_cap: bool = True) -> DataFrame:
    """M2: A2 → keep total_revenue <= its ``revenue_quantile`` over all products
    → keep num_transactions >= ``min_transactions`` (F6).

    The cap is the exact linear-interpolated quantile over all products,
    computed without gathering the catalogue in one task
    (``quantiles.exact_quantiles``); ``exact_cap=False`` takes
    ``percentile_approx`` instead.  The per-product table is written once: the
    cap and the filter both read it, instead of aggregating all lines twice.
    """
    return _active_below_cap(product_aggregates(clean_product), revenue_quantile, min_transactions, exact_cap)


def product_features_of_partials(partials: DataFrame, revenue_quantile: float = 0.99, min_transactions: int = 10, exact_cap: bool = True) -> DataFrame:
    """``build_product_features`` from partials."""
    return _active_below_cap(_product_totals(merged_product_partials(partials)), revenue_quantile, min_transactions, exact_cap)


def _active_below_cap(agg: DataFrame, revenue_quantile: float, min_transactions: int, exact_cap: bool) -> DataFrame:
    agg = materialize(agg)
    if exact_cap:
        cap = quantile_columns(agg, [], "total_revenue", {"cap": revenue_quantile}).select("cap").scalar()
    else:
        cap = agg.select(F.percentile_approx("total_revenue", F.lit(revenue_quantile), F.lit(100000))).scalar()
    return agg.filter((F.col("total_revenue") <= cap) & (F.col("num_transactions") >= min_transactions))


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 %, max per feature, rounded 2.

    Exact quartiles (``df.summary`` is approximate) from the distributed
    quantile operator; the moments are one aggregation over the features
    unpivoted to (feature, value).  The unpivoted table is written once for both.
    """
    long = materialize(df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p")
    ).select("p.feature", "p.v"))
    moments = long.groupBy("feature").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    quart = quantile_columns(long, ["feature"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return (moments.join(quart, "feature", "left")
            .select("feature", "count", *[F.round(s, 2).alias(s) for s in stats]))
