"""Segment and insight queries over the segmented tables
(A8, A10–A12, A14, A16, A19, J2, J3, J7, W1, W3, O4, O5, P9, Q2, Q3, Q7–Q18).

The segmented tables hold one row per customer / product.  Everything grouped
by segment is a hash aggregation with partial aggregation (a segment holding
a third of all rows still ships one partial row per partition), then a join
with the 4-row segment dimension (broadcast).  Windows without a partition key
only ever run on those few grouped rows or after a ``limit``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions import dims
from tillroll.operators.quantiles import quantile_columns
from tillroll.operators.rules import round_half_even, rule_order
from tillroll.session import materialize


def segment_counts(seg: DataFrame, segment_col: str = "Segment") -> DataFrame:
    """A8 + A10: count per non-null segment, descending, and its share of all
    rows (null segments count in the denominator), rounded to 1 decimal."""
    total = seg.select(F.count(F.lit(1))).scalar()
    counts = seg.filter(F.col(segment_col).isNotNull()).groupBy(segment_col).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(segment_col, "count",
                         round_half_even(F.col("count") / total * 100, 1).alias("percentage"),
                         total.alias("total"))


def segment_summary(spark: SparkSession, seg: DataFrame, kind: str) -> DataFrame:
    """Q3/Q7: count, percent and action per segment (J2: missing action -> "")."""
    dim = F.broadcast(dims.segment_dim(spark, kind).select("Segment", "action"))
    return (segment_counts(seg).join(dim, "Segment", "left")
            .select("Segment", "count", "percentage", F.coalesce("action", F.lit("")).alias("action"), "total"))


def segment_distribution(spark: SparkSession, seg: DataFrame, kind: str) -> DataFrame:
    """Counts on the fixed segment order, missing segments = 0, percent of all rows."""
    dim = F.broadcast(dims.segment_dim(spark, kind).select("Segment", "seg_order"))
    total = seg.select(F.count(F.lit(1))).scalar()
    counts = seg.groupBy("Segment").agg(F.count(F.lit(1)).alias("n"))
    return (dim.join(counts, "Segment", "left")
            .select(F.lit(kind).alias("kind"), "Segment", "seg_order",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
                    round_half_even(F.coalesce("n", F.lit(0)) / total * 100, 1).alias("percentage")))


def _grid(c):
    """Means on a 1e-6 grid: independent of the summation order across partitions."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def segment_profile(seg: DataFrame, features: list[str], invert: tuple[str, ...] = (),
                    exact: dict[str, str] | None = None) -> DataFrame:
    """Q16: A11 means per segment (rounded 2) and A12 min-max normalised means
    (0..1 across segments; ``invert`` features as 1 - x; constant -> null).
    Means are kept on a 1e-6 grid before normalising."""
    exact = exact or {}
    aggs = []
    for f in features:
        x = F.col(f).cast(exact[f]) if f in exact else F.col(f)
        aggs.append(_grid(F.sum(x).cast("double") / F.count(x)).alias(f"m_{f}"))
    means = seg.filter(F.col("Segment").isNotNull()).groupBy("Segment").agg(*aggs)
    allw = Window.partitionBy()  # over the few segment rows only
    cols = ["Segment"]
    for f in features:
        m = F.col(f"m_{f}")
        lo, hi = F.min(m).over(allw), F.max(m).over(allw)
        norm = (m - lo) / F.when(hi - lo != 0, hi - lo)
        if f in invert:
            norm = F.lit(1.0) - norm
        cols += [round_half_even(m, 2).alias(f"mean_{f}"), norm.alias(f"norm_{f}")]
    return means.select(*cols)


def _fenced(seg: DataFrame, id_col: str | None, features: list[str]) -> DataFrame:
    """Every (segment, feature, value) beside its quartiles; the unpivoted table is written once for both passes.

    Quartiles are exact and distributed (``quantiles.exact_quantiles``: a
    segment holding a third of all rows is never gathered in one task)."""
    ids = [F.col(id_col).alias("id")] if id_col else []
    long = seg.filter(F.col("Segment").isNotNull()).select(
        "Segment", *ids, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
                                             for f in features])).alias("p")).select("Segment", *(["id"] if id_col else []), "p.feature", "p.v")
    long = materialize(long)
    q = quantile_columns(long, ["Segment", "feature"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # on the 1e-6 grid: an engine may or may not fuse the interpolation's multiply-add
    q = q.withColumns({c: _grid(F.col(c)) for c in ("q1", "median", "q3")}).withColumn("iqr", F.col("q3") - F.col("q1"))
    fenced = long.join(F.broadcast(q), ["Segment", "feature"])  # segments x features rows
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    return fenced.withColumn("inside", (F.col("v") >= lo_f) & (F.col("v") <= hi_f))


def segment_boxplot(seg: DataFrame, features: list[str]) -> DataFrame:
    """Q17/A14 (long form: one row per segment x feature): quartiles (linear
    interpolation), whiskers = most extreme values inside Q1 - 1.5 IQR /
    Q3 + 1.5 IQR, number of outliers beyond them."""
    return _fenced(seg, None, features).groupBy("Segment", "feature", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("inside"), F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("inside"), F.col("v"))).alias("whisker_high"),
        F.count_if(~F.col("inside")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def boxplot_outliers(seg: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """A14's points beyond the whiskers: Segment, feature, id, value."""
    return _fenced(seg, id_col, features).filter(~F.col("inside")).select("Segment", "feature", "id", F.col("v").alias("value"))


def top_per_segment(seg: DataFrame, order_col: str, id_col: str, n: int) -> DataFrame:
    """Top n rows by ``order_col`` (desc, ties by id) within each segment;
    Catalyst limits each partition (``WindowGroupLimit``) before the shuffle."""
    w = Window.partitionBy("Segment").orderBy(F.desc(order_col), F.asc(id_col))
    return seg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_per_segment(seg: DataFrame, id_col: str, n: int) -> DataFrame:
    """First n rows per segment in stored order (id ascending)."""
    w = Window.partitionBy("Segment").orderBy(F.asc(id_col))
    return seg.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def top_products_per_segment(products: DataFrame, n: int = 10) -> DataFrame:
    """Q18: top n products by revenue per segment, with the 40-character label
    and revenue in thousands (P6)."""
    top = top_per_segment(products.filter(F.col("Segment").isNotNull()), "total_revenue", "Description", n)
    return top.select("Segment", "rank", "Description",
                      F.substring("Description", 1, 40).alias("label"),
                      "total_revenue", (F.col("total_revenue") / 1000).alias("revenue_k"))


def products_by_segment(spark: SparkSession, products: DataFrame, limit: int = 20) -> DataFrame:
    """Q8 for every valid segment at once: first ``limit`` products in stored
    order, the count after the limit (as the API reports it), the segment's
    full size and its action."""
    first = first_per_segment(products.filter(F.col("Segment").isin(dims.PRODUCT_SEGMENTS)), "Description", limit)
    sizes = products.groupBy("Segment").agg(F.count(F.lit(1)).alias("segment_size"))
    dim = F.broadcast(dims.segment_dim(spark, "product").select("Segment", "action"))
    return (first.join(F.broadcast(sizes), "Segment").join(dim, "Segment", "left")
            .select("Segment", "position", "Description", "avg_price", "total_quantity", "num_transactions",
                    "num_customers", "total_revenue",
                    F.least(F.col("segment_size"), F.lit(limit)).alias("count"), "segment_size", "action"))


def products_of_segment(spark: SparkSession, products: DataFrame, segment: str, limit: int = 20) -> DataFrame:
    """Q8/F11 for one segment; a name outside the four segments is an error that lists them."""
    if segment not in dims.PRODUCT_SEGMENTS:
        raise ValueError(f"invalid segment {segment!r}: choose from {dims.PRODUCT_SEGMENTS}")
    return products_by_segment(spark, products.filter(F.col("Segment") == segment), limit)


def customer_by_id(spark: SparkSession, customers: DataFrame, customer_id: str) -> DataFrame:
    """Q2/F10 for one customer: an equality that the scan of the stored table prunes files, row groups and pages by.  An unknown id gives no row."""
    return _looked_up(spark, customers.filter(F.col("CustomerID") == str(customer_id)))


def customer_lookup(spark: SparkSession, customers: DataFrame, ids: DataFrame) -> DataFrame:
    """Q2 in batch form: ``ids(customer_id)`` semi-joined to the segmented
    customers by text equality (unknown ids give no row)."""
    return _looked_up(spark, customers.join(ids.select(F.col("customer_id").cast("string").alias("CustomerID")).distinct(), "CustomerID"))


def _looked_up(spark: SparkSession, hit: DataFrame) -> DataFrame:
    dim = F.broadcast(dims.segment_dim(spark, "customer").select("Segment", "action"))
    return (hit.join(dim, "Segment", "left")
            .select(F.col("CustomerID").alias("customer_id"),
                    F.coalesce("Segment", F.lit("Unknown")).alias("segment"),
                    round_half_even(F.col("Recency").cast("double"), 2).alias("recency"),
                    F.col("Frequency").cast("bigint").alias("frequency"),
                    round_half_even("Monetary", 2).alias("monetary"),
                    F.coalesce("action", F.lit("")).alias("marketing_action")))


def score(spark: SparkSession, assigned: DataFrame, kind: str, labels: dict[int, str],
          cluster_col: str = "Cluster") -> DataFrame:
    """M11/M12 tail: cluster id -> segment ("Cluster n" when unknown) -> action
    and description (J1 + J2 on broadcast dimension tables)."""
    lab = spark.createDataFrame(sorted(labels.items()) or [(-1, "")], f"{cluster_col} int, _label string")
    dim = dims.segment_dim(spark, kind).select(F.col("Segment").alias("segment"), "action",
                                                F.col("description").alias("segment_description"))
    out = (assigned.join(F.broadcast(lab), cluster_col, "left")
           .withColumn("segment", F.coalesce("_label", F.concat(F.lit("Cluster "), F.col(cluster_col).cast("string"))))
           .drop("_label")
           .join(F.broadcast(dim), "segment", "left"))
    return out.withColumn("action", F.coalesce("action", F.lit(""))) \
              .withColumn("segment_description", F.coalesce("segment_description", F.lit(""))) \
              .withColumnRenamed(cluster_col, "cluster_id")


def overview_kpis(customers: DataFrame, products: DataFrame, rules: DataFrame) -> DataFrame:
    """Customers, total revenue, mean spend per customer (the API's
    "avg_order_value"), the true mean per invoice, products and rules —
    each a single global aggregate, combined as scalar subqueries."""
    money = F.col("Monetary").cast("decimal(28,2)")
    c = customers.agg(F.count(F.lit(1)).alias("n"), F.sum(money).alias("rev"), F.sum("Frequency").alias("inv"))
    n = c.select("n").scalar()
    rev = c.select("rev").scalar()
    inv = c.select("inv").scalar()
    spark = customers.sparkSession
    return spark.range(1).select(
        n.alias("total_customers"),
        round_half_even(rev.cast("double"), 2).alias("total_revenue_gbp"),
        round_half_even(rev.cast("double") / n, 2).alias("avg_order_value"),
        round_half_even(rev.cast("double") / inv, 2).alias("avg_invoice_value"),
        products.select(F.count(F.lit(1))).scalar().alias("total_products"),
        rules.select(F.count(F.lit(1))).scalar().alias("total_rules"))


def overview_top_rules(rules: DataFrame, n: int = 5) -> DataFrame:
    return rules.orderBy(*rule_order()).limit(n).select("antecedents_str", "consequents_str", "lift", "confidence")


def top_customers(customers: DataFrame, limit: int = 10, segment: str = "Champions") -> DataFrame:
    """O4 + W5: a segment's customers by Monetary descending (ties by id),
    with the leaderboard position (window over the <= limit rows kept)."""
    order = [F.desc("Monetary"), F.asc("CustomerID")]
    top = customers.filter(F.col("Segment") == segment).orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"),
                      "CustomerID", "Recency", "Frequency", "Monetary", "Segment")


def top_products(products: DataFrame, limit: int = 10) -> DataFrame:
    """O5 + W5."""
    order = [F.desc("total_revenue"), F.asc("Description")]
    top = products.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"),
                      "Description", "avg_price", "total_quantity", "total_revenue", "Segment")


def campaign_targets(spark: SparkSession, customers: DataFrame) -> DataFrame:
    """Q14/J7 + A19: campaign per segment with target count and percent, one
    row per recommended channel, and the addressable audience."""
    summary = segment_counts(customers)
    camp = F.broadcast(dims.campaign_dim(spark))
    return (camp.join(summary, "Segment", "left")
            .select("Segment", "strategy", "campaign_description", F.explode("channels").alias("channel"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("target_count"),
                    F.coalesce("percentage", F.lit(0.0)).alias("percentage"),
                    customers.select(F.count(F.lit(1))).scalar().alias("addressable_audience")))


def scatter_customers(customers: DataFrame) -> DataFrame:
    """(Recency, Frequency, Monetary, Segment) points, all of them."""
    return customers.select("CustomerID", "Recency", "Frequency", "Monetary", "Segment")


def scatter_products(products: DataFrame) -> DataFrame:
    """(avg_price, revenue in thousands, Segment) points, all of them."""
    return products.select("Description", "avg_price", (F.col("total_revenue") / 1000).alias("revenue_k"), "Segment")


def density(points: DataFrame, x: str, y: str, cells: int = 50) -> DataFrame:
    """P9 at any size: Segment, cell_x, cell_y, n on a grid of ``cells`` x ``cells`` over the range of all points.

    At most segments x cells^2 rows, counted partially first.  A column of one value lies in cell 0; points without x or y are left out."""
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("Segment", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = own.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).alias("ends")).scalar()
    cell = lambda c: F.when(ends[f"hi_{c}"] > ends[f"lo_{c}"], F.least(
        F.lit(cells - 1), F.floor((F.col(c) - ends[f"lo_{c}"]) * cells / (ends[f"hi_{c}"] - ends[f"lo_{c}"])).cast("int"))).otherwise(0)
    placed = own.select("Segment", cell("x").alias("cell_x"), cell("y").alias("cell_y"))
    return placed.groupBy("Segment", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))


def reservoir(points: DataFrame, ident: str, size: int = 100) -> DataFrame:
    """P9 at any size: a uniform sample of at most ``size`` points a segment, the ones with the least hash of their id: the same
    on every run, and a sample of two tables' union is the sample of their samples."""
    drawn = Window.partitionBy("Segment").orderBy(F.md5(F.col(ident).cast("binary")), F.col(ident))
    return points.withColumn("_draw", F.row_number().over(drawn)).where(F.col("_draw") <= size).drop("_draw")
