"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry composes operators from ``tillroll.operators`` over the whole
supplied tables.  Parameters that differ from the reference defaults are the
grain/threshold choices documented next to each entry (the supplied data has a
different shape than the original retail extract; see README).
"""
from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.operators import features as FE
from tillroll.operators import sketches as SK
from tillroll.session import checkpoint_root, materialize
from tillroll.sources.increments import Increments
from tillroll.sources.retail import read_extracts, read_transactions, retail_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _money(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ----------------------------------------------------------------- cleaning --
def clean_lines(spark, sf_dir, variant: str, dirty: bool = False, item: str = "product") -> DataFrame:
    """Cleaned lines; ``dirty`` ones carry all columns, the others only the joins their variant needs."""
    raw = retail_raw(spark, sf_dir, item=item, with_description=dirty or variant != "rfm", with_country=dirty, dirty=dirty)
    return C.clean(raw, variant)


@query("clean_rfm")
def q_clean_rfm(spark, sf_dir):
    return _money(clean_lines(spark, sf_dir, "rfm", dirty=True), "UnitPrice", "TotalPrice")


@query("clean_basket")
def q_clean_basket(spark, sf_dir):
    return _money(clean_lines(spark, sf_dir, "basket", dirty=True), "UnitPrice")


@query("clean_product")
def q_clean_product(spark, sf_dir):
    return _money(clean_lines(spark, sf_dir, "product", dirty=True), "UnitPrice", "TotalRevenue")


@query("transactions_csv")
def q_transactions_csv(spark, sf_dir):
    """The dirty lines written as two CSV extracts with the source's headers (blanks included), read back in one scan."""
    raw = retail_raw(spark, sf_dir, with_country=True, dirty=True)
    named = raw.select(F.col("InvoiceNo").alias(" Invoice"), "StockCode", "Description", "Quantity",
                       F.date_format("InvoiceDate", "M/d/yyyy H:mm:ss").alias("InvoiceDate"), F.col("UnitPrice").alias("Price "),
                       F.col("CustomerID").alias("Customer ID"), "Country")
    paths = []
    for year, own in (("early", F.year(raw.InvoiceDate) < 1995), ("late", F.year(raw.InvoiceDate) >= 1995)):
        path = f"{checkpoint_root(spark)}/tables/{year}-{uuid.uuid4().hex}"
        named.filter(own).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        paths.append(path)
    return _money(read_transactions(spark, paths, timestamp_format="M/d/yyyy H:mm:ss"), "UnitPrice")


US_TIME = "M/d/yyyy H:mm:ss"


def _write_extract(df: DataFrame, name: str) -> str:
    path = f"{checkpoint_root(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("transactions_extracts")
def q_transactions_extracts(spark, sf_dir):
    """The dirty lines as three CSV extracts whose headers differ in spelling, order and number, read as one table."""
    raw = retail_raw(spark, sf_dir, with_country=True, dirty=True).withColumn("year", F.year("InvoiceDate")).withColumn("date", F.date_format("InvoiceDate", US_TIME))
    first = raw.filter("year < 1994").select(F.col("InvoiceNo").alias(" Invoice"), "StockCode", "Description", "Quantity", F.col("date").alias("InvoiceDate"),
                                             F.col("UnitPrice").alias("Price "), F.col("CustomerID").alias("Customer ID"), "Country")
    second = raw.filter("year in (1994, 1995)").select("CustomerID", "UnitPrice", F.col("date").alias("Invoice Date"), "Quantity", "StockCode", "Description", "InvoiceNo")
    third = raw.filter("year > 1995").select(F.lit("seen").alias("Note"), "Country", F.col("CustomerID").alias("Customer ID"), F.col("UnitPrice").alias("Price"),
                                             F.col("date").alias("InvoiceDate"), "Quantity", "Description", "StockCode", F.col("InvoiceNo").alias("Invoice"))
    paths = [_write_extract(df, f"extract{k}") for k, df in enumerate((first, second, third))]
    return _money(read_extracts(spark, paths, timestamp_format=US_TIME)[0], "UnitPrice")


@query("transactions_rejected")
def q_transactions_rejected(spark, sf_dir):
    """Cells that are no value of their column, by fixed rules over every line, come back as rejected rows with the reason."""
    raw = retail_raw(spark, sf_dir, dirty=True)
    bad = lambda n: F.col("StockCode").cast("bigint") % n == 0
    named = raw.select("InvoiceNo", "StockCode", F.when(bad(11), F.concat("Quantity", F.lit(" pcs"))).otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
                       F.when(bad(13), F.date_format("InvoiceDate", "yyyy.MM.dd")).otherwise(F.date_format("InvoiceDate", US_TIME)).alias("InvoiceDate"),
                       F.when(bad(17), F.replace(F.col("UnitPrice").cast("string"), F.lit("."), F.lit(","))).otherwise(F.col("UnitPrice").cast("string")).alias("Price"), "CustomerID")
    rejected = read_extracts(spark, _write_extract(named, "faulty"), timestamp_format=US_TIME)[1]
    return rejected.select("reason", "InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID")


@query("cleaning_report")
def q_cleaning_report(spark, sf_dir):
    return C.cleaning_report(retail_raw(spark, sf_dir, dirty=True))


@query("distinct_sketches")
def q_distinct_sketches(spark, sf_dir):
    """Distinct invoices, products and customers of each year, merged from the months' sketches, beside the exact counts."""
    columns = ["InvoiceNo", "StockCode", "CustomerID"]
    raw = retail_raw(spark, sf_dir, dirty=True).select("InvoiceDate", *columns)
    sketches = materialize(SK.distinct_sketches(raw, F.trunc("InvoiceDate", "month"), columns))
    return SK.checked_distinct(raw, sketches, F.year("InvoiceDate"), F.year("part"), columns).withColumnRenamed("key", "year")


# ----------------------------------------------------------------- features --
def rfm(spark, sf_dir, dirty: bool = False) -> DataFrame:
    return FE.build_rfm(clean_lines(spark, sf_dir, "rfm", dirty))


def product_features(spark, sf_dir, dirty: bool = False) -> DataFrame:
    return FE.build_product_features(clean_lines(spark, sf_dir, "product", dirty))


@query("rfm")
def q_rfm(spark, sf_dir):
    return rfm(spark, sf_dir)


@query("rfm_dirty")
def q_rfm_dirty(spark, sf_dir):
    return rfm(spark, sf_dir, dirty=True)


@query("reference_date")
def q_reference_date(spark, sf_dir):
    return FE.reference_date(clean_lines(spark, sf_dir, "rfm"))


@query("rfm_describe")
def q_rfm_describe(spark, sf_dir):
    return FE.describe(rfm(spark, sf_dir), FE.RFM_FEATURES)


@query("product_features")
def q_product_features(spark, sf_dir):
    return product_features(spark, sf_dir)


@query("product_features_dirty")
def q_product_features_dirty(spark, sf_dir):
    return product_features(spark, sf_dir, dirty=True)


@query("product_describe")
def q_product_describe(spark, sf_dir):
    return FE.describe(product_features(spark, sf_dir), FE.PRODUCT_FEATURES)


def _refreshed(spark, sf_dir) -> Increments:
    """The dirty lines land in three deliveries, so that invoices lie in several; the features follow after each."""
    base = f"{checkpoint_root(spark)}/tables/increments-{uuid.uuid4().hex}"
    raw = retail_raw(spark, sf_dir, dirty=True)
    kept = Increments(spark, f"{base}/landing", f"{base}/partials", lambda paths: spark.read.schema(raw.schema).parquet(*paths))
    for k in range(3):
        raw.filter(F.pmod(F.col("StockCode").cast("bigint"), F.lit(3)) == k).write.mode("append").parquet(f"{base}/landing")
        kept.refresh()
    return kept


@query("rfm_incremental")
def q_rfm_incremental(spark, sf_dir):
    return _refreshed(spark, sf_dir).rfm()


@query("product_features_incremental")
def q_product_features_incremental(spark, sf_dir):
    kept = _refreshed(spark, sf_dir)
    kept.compact()
    return kept.product_features()


# ------------------------------------------------------------------ baskets --
from dataclasses import dataclass  # noqa: E402

from tillroll.functions.text import items_text  # noqa: E402
from tillroll.operators import baskets as B  # noqa: E402
from tillroll.operators import itemsets as I  # noqa: E402
from tillroll.operators import rules as R  # noqa: E402
from tillroll.sources.store import Store  # noqa: E402


@dataclass(frozen=True)
class BasketConfig:
    """Basket grain and mining thresholds.

    The reference mines invoices x product descriptions at support 0.03; on the
    supplied tables no item pair reaches that at this grain.  The registered
    queries take the customer as the basket and the part type as the item
    (support 0.15: rules at every scale factor), and orders x part type for
    rules below lift 1.  Confidence 0.3, lift 1.0 and max length 3 are the
    reference values.  No item is dropped before mining.
    """
    basket_col: str = "CustomerID"
    item: str = "type"
    min_support: float = 0.15
    min_confidence: float = 0.3
    min_lift: float = 1.0
    min_count: int = 1
    max_items: int | None = None
    max_len: int = 3

    @property
    def spec(self) -> B.BasketSpec:
        return B.BasketSpec(self.basket_col, "Description", self.min_count, self.max_items)


MAIN = BasketConfig()
# F7 + O3 with the reference's own numbers, at a grain where they bite.
CAPPED = BasketConfig(item="product", min_count=5, max_items=500)
MULTI = BasketConfig(basket_col="InvoiceNo", item="type", min_support=0.03, min_lift=0.0)


def basket_clean(spark, sf_dir, cfg: BasketConfig, dirty: bool = False) -> DataFrame:
    return clean_lines(spark, sf_dir, "basket", dirty, cfg.item)


def itemsets(spark, sf_dir, cfg: BasketConfig = MAIN, dirty: bool = False) -> DataFrame:
    pairs, n = B.prepare(basket_clean(spark, sf_dir, cfg, dirty), cfg.spec)
    return I.frequent_itemsets(pairs, n, cfg.min_support, cfg.max_len)


def rules(spark, sf_dir, cfg: BasketConfig = MAIN, dirty: bool = False) -> DataFrame:
    return R.association_rules(itemsets(spark, sf_dir, cfg, dirty), cfg.min_confidence, cfg.min_lift)


def _itemset_out(df: DataFrame) -> DataFrame:
    return df.select(items_text("items").alias("items_str"), "freq", "support", "length")


@query("item_frequency")
def q_item_frequency(spark, sf_dir):
    return B.item_frequency(B.basket_pairs(basket_clean(spark, sf_dir, CAPPED), CAPPED.spec))


@query("basket_items")
def q_basket_items(spark, sf_dir):
    return B.basket_items(basket_clean(spark, sf_dir, CAPPED), CAPPED.spec)


@query("frequent_itemsets")
def q_frequent_itemsets(spark, sf_dir):
    return _itemset_out(itemsets(spark, sf_dir, MAIN))


@query("frequent_itemsets_multi")
def q_frequent_itemsets_multi(spark, sf_dir):
    return _itemset_out(itemsets(spark, sf_dir, MULTI))


@query("frequent_itemsets_fpgrowth")
def q_frequent_itemsets_fpgrowth(spark, sf_dir):
    clean = basket_clean(spark, sf_dir, MAIN)
    arrays = B.basket_arrays(clean, MAIN.spec)
    return _itemset_out(I.frequent_itemsets_fpgrowth(arrays, MAIN.min_support, MAIN.max_len))


RFM_MONEY = {"Monetary": "decimal(28,2)"}


def _store(spark, sf_dir) -> Store:
    """The store of this version of the input and of all parameters that the jobs run with, their defaults included."""
    jobs = (FE.build_rfm, FE.build_product_features, retail_raw, B.BasketSpec, I.frequent_itemsets, R.association_rules, K.segment, K.fit_fixed_kmeans, K.train_kmeans)
    return Store(spark, sf_dir, repr((MAIN, K_FINAL, K.N_INIT, K.MAX_ITER, RFM_MONEY, *[(f.__name__, str(inspect.signature(f))) for f in jobs])))


def stored_itemsets(spark, sf_dir) -> DataFrame:
    """What the mining job stored (it runs only where the store has no itemsets yet)."""
    return _store(spark, sf_dir).table("itemsets", lambda: itemsets(spark, sf_dir, MAIN))


def stored_rules(spark, sf_dir) -> DataFrame:
    return _store(spark, sf_dir).table(
        "rules", lambda: R.association_rules(stored_itemsets(spark, sf_dir), MAIN.min_confidence, MAIN.min_lift))


@query("itemset_length_histogram")
def q_itemset_length_histogram(spark, sf_dir):
    return R.itemset_length_histogram(stored_itemsets(spark, sf_dir))


@query("association_rules")
def q_association_rules(spark, sf_dir):
    return rules(spark, sf_dir, MAIN).select(*R.RULE_COLS)


@query("association_rules_dirty")
def q_association_rules_dirty(spark, sf_dir):
    """Null customers, null and padded descriptions and zero prices go through mining."""
    return rules(spark, sf_dir, MAIN, dirty=True).select(*R.RULE_COLS)


@query("association_rules_multi")
def q_association_rules_multi(spark, sf_dir):
    return rules(spark, sf_dir, MULTI).select(*R.RULE_COLS)


@query("rule_counts_by_lift")
def q_rule_counts_by_lift(spark, sf_dir):
    return R.rule_counts(stored_rules(spark, sf_dir))


RECOMMEND_PRODUCT = "promo"


@query("recommend_basket")
def q_recommend_basket(spark, sf_dir):
    return R.recommend(stored_rules(spark, sf_dir), RECOMMEND_PRODUCT, top_n=5)


@query("recommend_batch")
def q_recommend_batch(spark, sf_dir):
    products = stored_itemsets(spark, sf_dir).filter(F.col("length") == 1).select(F.element_at("items", 1).alias("product"))
    return R.recommend_batch(stored_rules(spark, sf_dir), products, top_n=5)


@query("recommendable_products")
def q_recommendable_products(spark, sf_dir):
    return R.recommendable_products(stored_rules(spark, sf_dir))


@query("top_rules")
def q_top_rules(spark, sf_dir):
    return R.top_rules(stored_rules(spark, sf_dir), 20)


@query("top_single_items")
def q_top_single_items(spark, sf_dir):
    return R.top_single_items(stored_itemsets(spark, sf_dir), 15)


@query("rule_matrix")
def q_rule_matrix(spark, sf_dir):
    return R.rule_matrix(stored_rules(spark, sf_dir), 15)


@query("rule_grid")
def q_rule_grid(spark, sf_dir):
    return R.rule_grid(stored_rules(spark, sf_dir), 15)


@query("top50_export")
def q_top50_export(spark, sf_dir):
    """Q22 written as a CSV with its display names and read back with the stored schema."""
    out = R.top50_export(stored_rules(spark, sf_dir), 50)
    path = write_table(out, f"{checkpoint_root(spark)}/tables/top50-{uuid.uuid4().hex}", fmt="csv")
    return read_csv(spark, path, out.schema)


@query("scatter_rules")
def q_scatter_rules(spark, sf_dir):
    return R.scatter_rules(stored_rules(spark, sf_dir))


# --------------------------------------------------------------- clustering --
from tillroll.operators import kmeans as K  # noqa: E402
from tillroll.operators import scaling as S  # noqa: E402
from tillroll.operators import segments as G  # noqa: E402
from tillroll.operators import silhouette as SI  # noqa: E402
from tillroll.sources.tables import read_csv, row_counts, table, write_table  # noqa: E402

K_FINAL = 4          # reference FINAL_K
MONEY = RFM_MONEY
CUSTOMER_COLS = ["CustomerID", "Frequency", "Monetary", "Recency", "Cluster", "Segment"]
PRODUCT_COLS = ["Description", *FE.PRODUCT_FEATURES, "Cluster", "Segment"]


def customer_job(spark, sf_dir) -> tuple[DataFrame, K.FixedKMeansModel]:
    """Fits the customer model and assigns every customer."""
    seg, model = K.segment(materialize(rfm(spark, sf_dir)), "CustomerID", FE.RFM_FEATURES, "customer", K_FINAL, money=MONEY)
    return seg.select(*CUSTOMER_COLS), model


def product_job(spark, sf_dir) -> tuple[DataFrame, K.FixedKMeansModel]:
    seg, model = K.segment(materialize(product_features(spark, sf_dir)), "Description", FE.PRODUCT_FEATURES, "product", K_FINAL)
    return seg.select(*PRODUCT_COLS), model


def _stored_segments(spark, sf_dir, kind, job) -> tuple[DataFrame, K.FixedKMeansModel]:
    """The segment table and its model as the job stored them; the job runs only where they are missing."""
    store = _store(spark, sf_dir)
    path = store.model_path(f"{kind}-model")

    def run():
        seg, model = job(spark, sf_dir)
        model.save(spark, path)
        return seg

    seg = store.table(f"{kind}s", run, by={"customer": "CustomerID", "product": "Description"}[kind])
    return seg, K.FixedKMeansModel.load(spark, path)


def customers_segmented(spark, sf_dir):
    return _stored_segments(spark, sf_dir, "customer", customer_job)


def products_segmented(spark, sf_dir):
    return _stored_segments(spark, sf_dir, "product", product_job)


def _scaled(df, id_col, features):
    out = S.standard_scale(df, features)
    return out.select(id_col, *[f"z_{f}" for f in features], *[f"z_{f}_milli" for f in features])


@query("scaled_rfm")
def q_scaled_rfm(spark, sf_dir):
    return _scaled(rfm(spark, sf_dir), "CustomerID", FE.RFM_FEATURES)


@query("scaled_products")
def q_scaled_products(spark, sf_dir):
    return _scaled(product_features(spark, sf_dir), "Description", FE.PRODUCT_FEATURES)


@query("kmeans_fixed_customers")
def q_kmeans_fixed_customers(spark, sf_dir):
    """Fits the model (the job itself, not the store)."""
    return customer_job(spark, sf_dir)[0]


@query("kmeans_fixed_products")
def q_kmeans_fixed_products(spark, sf_dir):
    """Fits the model (the job itself, not the store)."""
    return product_job(spark, sf_dir)[0]


def _means_long(seg, kind, features, exact=None):
    m = K.cluster_means(seg, features, exact=exact)
    m = m.join(seg.select("Cluster", "Segment").distinct(), "Cluster")
    body = ", ".join(f"'{f}', mean_{f}" for f in features)
    return m.selectExpr(f"'{kind}' AS kind", "Cluster", "Segment", "n",
                        f"stack({len(features)}, {body}) AS (feature, mean)") \
            .withColumn("mean", R.round_half_even("mean", 2))


@query("cluster_means")
def q_cluster_means(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    p, _ = products_segmented(spark, sf_dir)
    return _means_long(c, "customer", FE.RFM_FEATURES, MONEY).unionByName(
        _means_long(p, "product", FE.PRODUCT_FEATURES))


@query("score_customers")
def q_score_customers(spark, sf_dir):
    """M11 over every customer's RFM row, with the stored model."""
    _, model = customers_segmented(spark, sf_dir)
    r = rfm(spark, sf_dir).select("CustomerID", "Recency", "Frequency", "Monetary")
    scored = G.score(spark, model.assign(r), "customer", model.labels)
    return scored.select("CustomerID", F.col("Recency").alias("recency"), F.col("Frequency").alias("frequency"),
                         F.col("Monetary").alias("monetary"), "cluster_id", "segment",
                         F.col("action").alias("marketing_action"),
                         "segment_description")


@query("score_products")
def q_score_products(spark, sf_dir):
    """M12 over every product's feature row, with the stored model."""
    _, model = products_segmented(spark, sf_dir)
    p = product_features(spark, sf_dir)
    scored = G.score(spark, model.assign(p), "product", model.labels)
    return scored.select("Description", *FE.PRODUCT_FEATURES, "cluster_id", "segment",
                         F.col("action").alias("seller_action"), "segment_description")


@query("customer_lookup")
def q_customer_lookup(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    ids = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("customer_id"))
    return G.customer_lookup(spark, c, ids)


@query("customer_summary")
def q_customer_summary(spark, sf_dir):
    return G.segment_summary(spark, customers_segmented(spark, sf_dir)[0], "customer")


@query("product_summary")
def q_product_summary(spark, sf_dir):
    return G.segment_summary(spark, products_segmented(spark, sf_dir)[0], "product")


@query("products_by_segment")
def q_products_by_segment(spark, sf_dir):
    return G.products_by_segment(spark, products_segmented(spark, sf_dir)[0], 20)


@query("overview_kpis")
def q_overview_kpis(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    p, _ = products_segmented(spark, sf_dir)
    return G.overview_kpis(c, p, stored_rules(spark, sf_dir))


@query("overview_top_rules")
def q_overview_top_rules(spark, sf_dir):
    return G.overview_top_rules(stored_rules(spark, sf_dir), 5)


@query("top_customers")
def q_top_customers(spark, sf_dir):
    return G.top_customers(customers_segmented(spark, sf_dir)[0], 10)


@query("top_products")
def q_top_products(spark, sf_dir):
    return G.top_products(products_segmented(spark, sf_dir)[0], 10)


@query("segment_distribution")
def q_segment_distribution(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    p, _ = products_segmented(spark, sf_dir)
    return G.segment_distribution(spark, c, "customer").unionByName(G.segment_distribution(spark, p, "product"))


@query("segment_profile_customers")
def q_segment_profile_customers(spark, sf_dir):
    return G.segment_profile(customers_segmented(spark, sf_dir)[0], FE.RFM_FEATURES, invert=("Recency",),
                             exact=MONEY)


@query("segment_profile_products")
def q_segment_profile_products(spark, sf_dir):
    return G.segment_profile(products_segmented(spark, sf_dir)[0], FE.PRODUCT_FEATURES)


@query("segment_boxplot")
def q_segment_boxplot(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    p, _ = products_segmented(spark, sf_dir)
    return (G.segment_boxplot(c, FE.RFM_FEATURES).withColumn("kind", F.lit("customer"))
            .unionByName(G.segment_boxplot(p, FE.PRODUCT_FEATURES).withColumn("kind", F.lit("product"))))


@query("boxplot_outliers")
def q_boxplot_outliers(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    p, _ = products_segmented(spark, sf_dir)
    return (G.boxplot_outliers(c, "CustomerID", FE.RFM_FEATURES).withColumn("kind", F.lit("customer"))
            .unionByName(G.boxplot_outliers(p, "Description", FE.PRODUCT_FEATURES).withColumn("kind", F.lit("product"))))


@query("scatter_customers")
def q_scatter_customers(spark, sf_dir):
    return G.scatter_customers(customers_segmented(spark, sf_dir)[0])


@query("scatter_products")
def q_scatter_products(spark, sf_dir):
    return G.scatter_products(products_segmented(spark, sf_dir)[0])


@query("density_customers")
def q_density_customers(spark, sf_dir):
    """Customers by recency and amount, counted by cell of a plot."""
    return G.density(customers_segmented(spark, sf_dir)[0], "Recency", "Monetary")


@query("density_products")
def q_density_products(spark, sf_dir):
    return G.density(products_segmented(spark, sf_dir)[0], "avg_price", "total_revenue")


@query("reservoir_customers")
def q_reservoir_customers(spark, sf_dir):
    """A hundred points a segment (the sample is the feature)."""
    return G.reservoir(G.scatter_customers(customers_segmented(spark, sf_dir)[0]), "CustomerID")


@query("quantile_sketches")
def q_quantile_sketches(spark, sf_dir):
    """Quantiles of all rows from the segments' sketches, held against the rows' ranks."""
    out = None
    for kind, (df, _), features in (("customer", customers_segmented(spark, sf_dir), FE.RFM_FEATURES), ("product", products_segmented(spark, sf_dir), FE.PRODUCT_FEATURES)):
        long = df.select("Segment", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p"))
        long = long.select(F.lit(kind).alias("kind"), "Segment", "p.*")
        out = long if out is None else out.unionByName(long)
    long = materialize(out)
    sketches = materialize(SK.quantile_sketches(long, ["kind", "feature", "Segment"]))
    quantiles = materialize(SK.merged_quantiles(sketches, ["kind", "feature"], [0.25, 0.5, 0.75, 0.99]))
    return SK.checked_quantiles(long, quantiles, ["kind", "feature"])


@query("top_products_per_segment")
def q_top_products_per_segment(spark, sf_dir):
    return G.top_products_per_segment(products_segmented(spark, sf_dir)[0], 10)


@query("campaign_targets")
def q_campaign_targets(spark, sf_dir):
    return G.campaign_targets(spark, customers_segmented(spark, sf_dir)[0])


@query("dataset_health")
def q_dataset_health(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    p, _ = products_segmented(spark, sf_dir)
    return row_counts({"customers": c, "products": p, "rules": stored_rules(spark, sf_dir)})


# Trained (pyspark.ml) models: iterative and seed-driven, so rows-only checks; their
# invariants are checked in ``trained_invariants``.
def _trained(df: DataFrame, features: list[str], name: str):
    """Trained, saved and loaded again."""
    spark = df.sparkSession
    model, cost = K.train_kmeans(df, features, k=K_FINAL)
    path = f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    K.save_pipeline(model, path)
    return K.load_pipeline(path), cost


def stored_trained(spark, sf_dir, kind: str):
    """The trained pipeline and its clusters' labels as stored for this version of the input; trained only where they are missing."""
    features, money, job = {"customer": (FE.RFM_FEATURES, MONEY, rfm), "product": (FE.PRODUCT_FEATURES, None, product_features)}[kind]
    store = _store(spark, sf_dir)
    path = store.model_path(f"{kind}-trained-model")

    def run():
        df = materialize(job(spark, sf_dir))
        model, _ = K.train_kmeans(df, features, k=K_FINAL)
        K.save_pipeline(model, path)
        return K.score_trained(model, df, features, kind, money).select("Cluster", "Segment").distinct().coalesce(1)  # k rows

    labels = {r.Cluster: r.Segment for r in store.table(f"{kind}-trained-labels", run).collect()}
    return K.load_pipeline(path), labels


@query("kmeans_trained_customers")
def q_kmeans_trained_customers(spark, sf_dir):
    r = materialize(rfm(spark, sf_dir))
    model, _ = _trained(r, FE.RFM_FEATURES, "rfm-pipeline")
    return K.score_trained(model, r, FE.RFM_FEATURES, "customer", MONEY).select("CustomerID", *FE.RFM_FEATURES, "Cluster", "Segment")


@query("kmeans_trained_products")
def q_kmeans_trained_products(spark, sf_dir):
    p = materialize(product_features(spark, sf_dir))
    model, _ = _trained(p, FE.PRODUCT_FEATURES, "product-pipeline")
    return K.score_trained(model, p, FE.PRODUCT_FEATURES, "product").select("Description", *FE.PRODUCT_FEATURES, "Cluster", "Segment")


@query("trained_invariants")
def q_trained_invariants(spark, sf_dir):
    """Nearest centre for every row and inertia equal to the recomputed sum, for both models."""
    out = []
    for kind, df, features in (("customer", rfm(spark, sf_dir), FE.RFM_FEATURES), ("product", product_features(spark, sf_dir), FE.PRODUCT_FEATURES)):
        df = materialize(df)
        model, cost = _trained(df, features, f"{kind}-pipeline")
        out.append(K.trained_invariants(model, df, cost).select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionByName(out[1])


SILHOUETTE_SAMPLE = 1000


@query("segment_silhouette")
def q_segment_silhouette(spark, sf_dir):
    """M6 of the served models: Euclidean beside squared, on the same sample of scaled rows."""
    out = []
    for kind, (seg, model), id_col, features in (("customer", customers_segmented(spark, sf_dir), "CustomerID", FE.RFM_FEATURES),
                                                 ("product", products_segmented(spark, sf_dir), "Description", FE.PRODUCT_FEATURES)):
        found = SI.silhouettes(model.scaler.transform(seg), id_col, [f"z_{f}_milli" for f in features], sample=SILHOUETTE_SAMPLE)
        out.append(found.select(F.lit(kind).alias("kind"), "n_rows", "n_sampled", F.round("euclidean", 6).alias("euclidean"), F.round("squared", 6).alias("squared")))
    return out[0].unionByName(out[1])


@query("k_sweep_customers")
def q_k_sweep_customers(spark, sf_dir):
    return K.k_sweep(materialize(rfm(spark, sf_dir)), FE.RFM_FEATURES)


@query("k_sweep_products")
def q_k_sweep_products(spark, sf_dir):
    return K.k_sweep(materialize(product_features(spark, sf_dir)), FE.PRODUCT_FEATURES)


# -------------------------------------------------------------------- users --
from tillroll.operators import users as U  # noqa: E402
from tillroll.sources import users as US  # noqa: E402

USER_QUERY, USER_ROLE = "0001", "customer"


@query("users_report")
def q_users_report(spark, sf_dir):
    return U.user_listing(US.users(spark, sf_dir))


@query("user_search")
def q_user_search(spark, sf_dir):
    return U.user_search(US.users(spark, sf_dir), USER_QUERY, USER_ROLE)


@query("user_roles")
def q_user_roles(spark, sf_dir):
    return U.user_roles(spark, US.users(spark, sf_dir))


@query("new_accounts")
def q_new_accounts(spark, sf_dir):
    return U.check_new_accounts(US.signups(spark, sf_dir), US.users(spark, sf_dir))


# ---------------------------------------------------------------- streaming --
from tillroll.functions import dims as D  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tillroll.streaming import kpis as ST  # noqa: E402
from tillroll.streaming import upserts as UP  # noqa: E402


def _events(spark, sf_dir):
    """The supplied folder holds every table; the glob picks the event files."""
    return ST.order_stream(spark, sf_dir.rstrip("/"), glob="events*.parquet")


@query("stream_kpis")
def q_stream_kpis(spark, sf_dir):
    orders = _events(spark, sf_dir)
    return ST.run_to_table(ST.live_kpis(orders, "1 day", "1 hour"), "kpis")


@query("stream_order_feed")
def q_stream_order_feed(spark, sf_dir):
    c, _ = customers_segmented(spark, sf_dir)
    c = materialize(c)
    orders = _events(spark, sf_dir)
    return ST.run_to_table(ST.enrich_orders(orders, c, D.segment_dim(spark, "customer")), "order_feed")


@query("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """RFM rows arrive as files; each micro-batch is scored against the
    saved model."""
    _, model = customers_segmented(spark, sf_dir)
    root = f"{checkpoint_root(spark)}/streams/rfm-in-{uuid.uuid4().hex}"
    r = rfm(spark, sf_dir).select("CustomerID", "Recency", "Frequency", "Monetary")
    write_table(r, root)
    rows = spark.readStream.schema(r.schema).parquet(root)
    scored = ST.score_stream(rows, model, spark, "customer").select(
        "CustomerID", F.col("Recency").alias("recency"), F.col("Frequency").alias("frequency"),
        F.col("Monetary").alias("monetary"), "cluster_id", "segment",
        F.col("action").alias("marketing_action"), "segment_description")
    return ST.run_to_table(scored, "scoring")


@query("stream_trained_scoring")
def q_stream_trained_scoring(spark, sf_dir):
    """T3 with the trained model: feature rows arrive twice, first as they stood after a customer's first order, then as they are; the stream stops in between.
    Each micro-batch is scored and upserted, so that a customer has one row; ``agrees`` compares it with scoring the whole table at once."""
    model, labels = stored_trained(spark, sf_dir, "customer")
    base, now = UP.stream_base(spark, "trained"), materialize(rfm(spark, sf_dir).select("CustomerID", *FE.RFM_FEATURES))
    table_ = UP.UpsertTable(spark, f"{base}/scores", T.StructType([*now.schema.fields, T.StructField("Cluster", T.IntegerType()), T.StructField("Segment", T.StringType())]), ["CustomerID"])
    arrive = lambda df: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in now.schema]).write.mode("append").parquet(f"{base}/in")

    def scored(batch):
        assigned = model.transform(batch).select(*batch.columns, F.col("Cluster").cast("int").alias("Cluster"))
        return K.attach_labels(assigned, spark, labels)

    out = None
    for rows in (now.withColumn("Frequency", F.lit(1)).withColumn("Monetary", F.lit(0)), now):
        arrive(rows)
        out = UP.run_upserts(spark.readStream.schema(now.schema).parquet(f"{base}/in"), table_, base, scored)
    want = scored(now).select("CustomerID", F.struct("Cluster", "Segment").alias("want"))
    return out.join(want, "CustomerID", "full").select("CustomerID", *FE.RFM_FEATURES, (F.struct("Cluster", "Segment") == F.col("want")).alias("agrees"))


def _arriving(spark, sf_dir, name: str):
    """A stream over a folder that event files are put into one after the other."""
    base = UP.stream_base(spark, name)
    events = table(spark, sf_dir, "events")
    put = lambda df: df.write.mode("append").parquet(f"{base}/in")
    return base, events, put, lambda: ST.order_stream(spark, f"{base}/in")


@query("stream_kpis_open")
def q_stream_kpis_open(spark, sf_dir):
    """T1 continuously: windows in update mode with the open one, after a stop and a second delivery of a seventh of the events."""
    base, events, put, orders = _arriving(spark, sf_dir, "kpis-open")
    kpis = UP.UpsertTable(spark, f"{base}/kpis", "window_start timestamp_ntz, window_end timestamp_ntz, orders bigint, amount double, avg_amount double", ["window_start"])
    out = None
    for part in (events, events.filter("event_id % 7 = 0")):
        put(part)
        out = UP.run_upserts(ST.open_kpis(orders(), "1 day", "1 hour"), kpis, base, output_mode="update")
    return out


@query("stream_order_feed_live")
def q_stream_order_feed_live(spark, sf_dir):
    """T2 continuously: the segments are read for each micro-batch; they are published between the even and the odd orders."""
    c, _ = customers_segmented(spark, sf_dir)
    base, events, put, orders = _arriving(spark, sf_dir, "feed-live")
    segments, actions = UP.Versions(spark, f"{base}/segments"), D.segment_dim(spark, "customer")
    feed = UP.UpsertTable(spark, f"{base}/feed", "order_id bigint, customer_id string, ts timestamp_ntz, amount double, customer_segment string, marketing_action string", ["order_id"])
    out = None
    for rest, known in ((0, c.filter("false")), (1, c)):
        segments.publish(known.select("CustomerID", "Segment"))
        put(events.filter(F.col("event_id") % 2 == rest))
        out = UP.run_upserts(orders(), feed, base, lambda batch: ST.enrich_orders(batch, segments.latest(), actions))
    return out
