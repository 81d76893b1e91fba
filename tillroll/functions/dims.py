"""Small fixed dimension tables (segment labels, actions, campaigns, roles).

They are joined to data with ``broadcast`` — each has at most a handful of rows,
a size that does not grow with the data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values (must equal the served application's texts) ---------------
CUSTOMER_SEGMENTS = ["Champions", "Loyal", "At-Risk", "Lost"]
PRODUCT_SEGMENTS = ["Premium", "Trending", "Budget", "Niche"]

# Cluster id -> label maps of the original trained models (explicit override).
CUSTOMER_LABELS = {0: "At-Risk", 1: "Lost", 2: "Champions", 3: "Loyal"}
PRODUCT_LABELS = {0: "Budget", 1: "Trending", 2: "Premium", 3: "Niche"}

CUSTOMER_ACTIONS = {
    "Champions": "Reward with loyalty points. Show premium & new arrival products.",
    "Loyal": "Upsell higher-margin products. Ask for reviews. Offer early access.",
    "At-Risk": "Send win-back email with personalised discount code.",
    "Lost": "Last-chance offer or exit survey to understand churn reason.",
}
CUSTOMER_DESCRIPTIONS = {
    "Champions": "Recently purchased, buys often, high spender.",
    "Loyal": "Buys regularly, good frequency, decent spend.",
    "At-Risk": "Used to buy but hasn't recently. Needs attention.",
    "Lost": "Hasn't purchased in a long time. Very low activity.",
}
PRODUCT_ACTIONS = {
    "Premium": "Highlight as exclusive. Target Champions segment customers only.",
    "Trending": "Feature on homepage. Push to all customer segments.",
    "Budget": "Bundle with Premium items. Use in At-Risk win-back campaigns.",
    "Niche": "Target to specific loyal buyers. Avoid mass promotion.",
}
PRODUCT_DESCRIPTIONS = {
    "Premium": "High price, low volume. Exclusive item.",
    "Trending": "High sales velocity, broadly purchased.",
    "Budget": "Low price, decent volume. Mass market item.",
    "Niche": "High quantity but specific buyer group.",
}
CAMPAIGNS = {
    "Champions": ("VIP Loyalty Campaign",
                  "Reward your best customers with exclusive deals, early access to new products, and loyalty points.",
                  ["Email", "Push Notification", "SMS"]),
    "Loyal": ("Upsell Campaign",
              "Introduce higher-margin products, ask for reviews, and offer early access to sales.",
              ["Email", "Push Notification"]),
    "At-Risk": ("Win-Back Campaign",
                "Send personalised discount codes and remind them of products they viewed but didn't buy.",
                ["Email", "Retargeting Ads"]),
    "Lost": ("Re-engagement Campaign",
             "Last-chance offers, exit surveys, or sunset emails to understand why they left.",
             ["Email"]),
}
ROLES = ["customer", "seller", "marketer", "admin"]
# ------------------------------------------------------------------------------


def segment_dim(spark: SparkSession, kind: str) -> DataFrame:
    """(Segment, seg_order, action, description) for ``kind`` in {customer, product}."""
    if kind == "customer":
        names, actions, descs = CUSTOMER_SEGMENTS, CUSTOMER_ACTIONS, CUSTOMER_DESCRIPTIONS
    elif kind == "product":
        names, actions, descs = PRODUCT_SEGMENTS, PRODUCT_ACTIONS, PRODUCT_DESCRIPTIONS
    else:
        raise ValueError(kind)
    rows = [(s, i, actions[s], descs[s]) for i, s in enumerate(names)]
    schema = "Segment string, seg_order int, action string, description string"
    return spark.createDataFrame(rows, schema)


def campaign_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, i, c[0], c[1], c[2]) for i, (s, c) in enumerate(CAMPAIGNS.items())]
    schema = T.StructType([
        T.StructField("Segment", T.StringType()),
        T.StructField("seg_order", T.IntegerType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("campaign_description", T.StringType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
    ])
    return spark.createDataFrame(rows, schema)


def role_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, i) for i, r in enumerate(ROLES)], "role string, role_order int")
