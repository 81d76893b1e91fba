"""Cleaning edge rows (FIXTURES.md) and RFM recency."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.operators import features as FE
from tillroll.sources.retail import RETAIL_SCHEMA

T0 = dt.datetime(2011, 12, 9, 12, 0)


def raw(spark):
    d = Decimal
    rows = [
        ("536365", "A", "WHITE BAG", 6, T0, d("2.55"), "17850", "UK"),
        ("C536379", "A", "WHITE BAG", -1, T0, d("2.55"), "17850", "UK"),      # cancelled
        ("c536380", "B", "red cup", 2, T0, d("1.00"), "17850", "UK"),         # lower-case c: kept
        ("536381", "B", "red cup", 0, T0, d("1.00"), "13047", "UK"),          # zero quantity
        ("536382", "B", "red cup", 3, T0, d("0.00"), "13047", "UK"),          # zero price
        ("536383", "B", "red cup", None, T0, d("1.00"), "13047", "UK"),       # null quantity
        ("536384", "D", "LAMP", 1, T0, d("5.00"), None, "UK"),                # null customer
        ("536385", "E", None, 2, T0, d("3.00"), "13047", "UK"),               # null description
        ("536386", "F", " white bag\t", 1, T0, d("2.55"), "13047", "UK"),     # padded, other case
        ("536386", "F", " white bag\t", 2, T0, d("2.55"), "13047", "UK"),     # same item twice
        ("536387", "G", "MUG", 1, T0 - dt.timedelta(hours=23, minutes=50), d("1.00"), "99999", "UK"),
        ("536388", "H", "MUG", -2, T0, None, "13047", "UK"),                  # null price, negative qty
    ]
    return spark.createDataFrame(rows, RETAIL_SCHEMA)


def invoices(df):
    return sorted(r.InvoiceNo for r in df.select("InvoiceNo").collect())


def test_rfm_variant(spark):
    out = C.clean(raw(spark), "rfm")
    assert invoices(out) == ["536365", "536385", "536386", "536386", "536387", "c536380"]
    assert out.filter(F.col("InvoiceNo") == "536365").first().TotalPrice == Decimal("15.30")


def test_basket_variant_keeps_null_customer_and_case(spark):
    out = C.clean(raw(spark), "basket")
    assert "536384" in invoices(out) and "536385" not in invoices(out)
    descs = {r.Description for r in out.select("Description").distinct().collect()}
    assert {"WHITE BAG", "white bag"} <= descs  # two items: no upper-casing


def test_product_variant_merges_case(spark):
    out = C.clean(raw(spark), "product")
    assert "536384" not in invoices(out) and "536385" not in invoices(out)
    descs = {r.Description for r in out.select("Description").distinct().collect()}
    assert descs == {"WHITE BAG", "RED CUP", "MUG"}


def test_report(spark):
    rep = {r.variant: r for r in C.cleaning_report(raw(spark)).collect()}
    assert rep["rfm"].raw_rows == 12
    assert rep["rfm"].dropped_nulls == 1 and rep["rfm"].dropped_cancelled == 1
    assert rep["basket"].dropped_cancelled == 1 and rep["basket"].clean_rows == 6
    assert rep["product"].clean_rows == 5 and rep["product"].distinct_products == 3


def test_recency_whole_days(spark):
    rfm = {r.CustomerID: r for r in FE.build_rfm(C.clean(raw(spark), "rfm")).collect()}
    # reference date = T0 + 1 day; last purchase 47 h 50 min earlier -> 1 day
    assert rfm["99999"].Recency == 1
    assert rfm["17850"].Recency == 1 and rfm["17850"].Frequency == 2
    assert rfm["13047"].Frequency == 2  # 536385 and 536386


def test_product_features_cap_and_activity(spark):
    rows = [(f"P{i}", float(v)) for i, v in enumerate([1, 2, 3, 10])]
    df = spark.createDataFrame(rows, "Description string, v double")
    cap = df.select(F.percentile("v", F.lit(0.99))).first()[0]
    assert abs(cap - 9.79) < 1e-12  # exact, linear interpolation
