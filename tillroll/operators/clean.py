"""Cleaning (F1–F4, P1, C1, C2): one parametrised filter chain, three variants.

=========  =====================  ===============================  ==============
variant    null rows dropped      Description                      amount column
=========  =====================  ===============================  ==============
rfm        CustomerID             as read                          TotalPrice
basket     Description            whitespace-stripped              —
product    Description, Customer  stripped and upper-cased         TotalRevenue
=========  =====================  ===============================  ==============

All three drop cancelled invoices (text starting with "C") and lines whose
Quantity or UnitPrice is not positive (nulls fail).  The chain is a single
``filter`` that Catalyst pushes below the adapter's joins where it can.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import is_cancelled, py_strip
from tillroll.session import materialize

VARIANTS = ("rfm", "basket", "product")


def _amount(df: DataFrame) -> Column:
    return (F.col("Quantity").cast("decimal(10,0)") * F.col("UnitPrice")).cast("decimal(24,6)")


def _positive() -> Column:
    return F.coalesce((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0), F.lit(False))


def keep_predicate(variant: str) -> Column:
    """Row-level predicate of a cleaning variant (used by clean and the report)."""
    keep = ~is_cancelled("InvoiceNo") & _positive()
    if variant == "rfm":
        return keep & F.col("CustomerID").isNotNull()
    if variant == "basket":
        return keep & F.col("Description").isNotNull()
    if variant == "product":
        return keep & F.col("CustomerID").isNotNull() & F.col("Description").isNotNull()
    raise ValueError(f"variant must be one of {VARIANTS}")


def normalised_description(variant: str) -> Column:
    if variant == "basket":
        return py_strip("Description")
    if variant == "product":
        return F.upper(py_strip("Description"))
    return F.col("Description")


def clean(df: DataFrame, variant: str) -> DataFrame:
    """Cleaned lines of one variant, with the variant's amount column."""
    out = df.filter(keep_predicate(variant)).withColumn("Description", normalised_description(variant))
    if variant == "rfm":
        out = out.withColumn("TotalPrice", _amount(out))
    elif variant == "product":
        out = out.withColumn("TotalRevenue", _amount(out))
    return out


def cleaning_report(raw: DataFrame) -> DataFrame:
    """per variant raw rows, rows dropped for nulls, rows dropped as cancelled,
    clean rows, distinct products and distinct invoices.

    "dropped_cancelled" follows each job's step order: the RFM job drops
    missing customers first and counts cancellations among the rest; the other
    two count cancellations over all rows.  "dropped_nulls" counts rows removed
    by the variant's null step after its other filters (RFM: before them).

    One scan and one shuffle over the lines: a line gives two narrow rows, one keyed by its
    invoice (with the row counters) and one by its description, each with three keep flags;
    partial aggregation merges them per key.  Descriptions are normalised on the table of
    distinct ones.
    """
    cancelled = is_cancelled("InvoiceNo")
    positive = _positive()
    no_cust = F.col("CustomerID").isNull()
    no_desc = F.col("Description").isNull()
    nulls = {"rfm": no_cust, "basket": ~cancelled & positive & no_desc, "product": ~cancelled & positive & (no_desc | no_cust)}
    gone = {"rfm": ~no_cust & cancelled, "basket": cancelled, "product": cancelled}
    keep = {v: keep_predicate(v) for v in VARIANTS}
    counters = [F.lit(1).cast("bigint").alias("raw_rows")]
    for v in VARIANTS:
        counters += [nulls[v].cast("bigint").alias(f"{v}_nulls"), gone[v].cast("bigint").alias(f"{v}_cancelled"),
                     keep[v].cast("bigint").alias(f"{v}_clean")]
    flags = [keep[v].alias(f"{v}_keep") for v in VARIANTS]
    names = ["raw_rows"] + [f"{v}_{m}" for v in VARIANTS for m in ("nulls", "cancelled", "clean")]
    invoice = F.struct(F.lit("invoice").alias("tag"), F.col("InvoiceNo").alias("key"), *flags, *counters)
    product = F.struct(F.lit("product").alias("tag"), F.col("Description").alias("key"), *flags,
                       *[F.lit(0).cast("bigint").alias(n) for n in names])
    tagged = raw.select(F.explode(F.array(invoice, product)).alias("r")).select("r.*")
    keys = materialize(tagged.groupBy("tag", "key").agg(*[F.bool_or(f"{v}_keep").alias(f"{v}_keep") for v in VARIANTS],
                                                        *[F.sum(n).alias(n) for n in names]))
    rows = keys.filter("tag = 'invoice'").agg(
        *[F.sum(n).alias(n) for n in names],
        *[F.count_if(F.col(f"{v}_keep") & F.col("key").isNotNull()).alias(f"{v}_invoices") for v in VARIANTS])
    metrics = ["nulls", "cancelled", "clean", "invoices"]
    stack = ", ".join(f"'{v}', " + ", ".join(f"{v}_{m}" for m in metrics) for v in VARIANTS)
    rows = rows.selectExpr("raw_rows", f"stack({len(VARIANTS)}, {stack}) as (variant, dropped_nulls, dropped_cancelled, clean_rows, distinct_invoices)")
    described = keys.filter("tag = 'product' and key is not null").withColumnRenamed("key", "Description")
    named = described.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.when(F.col(f"{v}_keep"), normalised_description(v)).alias("name")) for v in VARIANTS])).alias("r")).select("r.*")
    products = named.filter("name is not null").distinct().groupBy("variant").agg(F.count(F.lit(1)).alias("distinct_products"))
    return rows.join(products, "variant", "left").select(
        F.coalesce("raw_rows", F.lit(0)).cast("bigint").alias("raw_rows"), "variant",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("dropped_nulls", "dropped_cancelled", "clean_rows", "distinct_products", "distinct_invoices")])
