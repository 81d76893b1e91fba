"""User table snapshot (S7) derived from the supplied ``customer`` table.

``users(id, name, email, role, is_active, created_at)`` — no password column
exists in the snapshot.  Role comes from the market segment, activity from the
account balance, the join date from the first order (one aggregation of
``orders`` by customer, joined back on the key).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import table

# Market segment -> application role (fixed mapping of this adapter).
SEGMENT_ROLE = {
    "AUTOMOBILE": "customer",
    "HOUSEHOLD": "customer",
    "BUILDING": "seller",
    "FURNITURE": "marketer",
    "MACHINERY": "admin",
}


def email_of(name_col) -> F.Column:
    return F.concat(F.lower(F.regexp_replace(name_col, "#", ".")), F.lit("@example.com"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    first_order = (table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
                   .groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at")))
    role = F.lit(None).cast("string")
    for seg, r in SEGMENT_ROLE.items():
        role = F.when(F.col("c_mktsegment") == seg, F.lit(r)).otherwise(role)
    return (cust.join(first_order, cust.c_custkey == first_order.o_custkey, "left")
            .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    email_of(F.col("c_name")).alias("email"),
                    F.coalesce(role, F.lit("customer")).alias("role"),
                    (F.col("c_acctbal") >= 0).alias("is_active"),
                    "created_at"))


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of account requests derived from the data, with their order of arrival: every
    supplier asks for a seller account (suppliers of nation 0 for an unknown role first, and again
    with the right one; those of nation 1 twice; those of nation 2 without a name), and every
    customer with a negative balance registers again with its address, in capitals for odd keys."""
    sup = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    ask = lambda prefix, shift, role: [
        F.concat(F.lit(prefix), F.col("s_suppkey").cast("string")).alias("request_id"),
        F.when(F.col("s_nationkey") != 2, F.col("s_name")).alias("name"), email_of(F.col("s_name")).alias("email"), role.alias("role"),
        (F.col("s_suppkey") * 10 + shift).cast("bigint").alias("arrival")]
    first = sup.select(*ask("S", 9, F.when(F.col("s_nationkey") == 0, F.lit("vendor")).otherwise(F.lit("seller"))))
    retry = sup.filter(F.col("s_nationkey") < 2).select(*ask("R", 10, F.lit("seller")))
    again = (table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
             .filter(F.col("c_acctbal") < 0)
             .select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("request_id"),
                     F.col("c_name").alias("name"),
                     F.when(F.col("c_custkey") % 2 == 1, F.upper(email_of(F.col("c_name")))).otherwise(email_of(F.col("c_name"))).alias("email"),
                     F.lit("customer").alias("role"), (F.col("c_custkey") * 10).cast("bigint").alias("arrival")))
    return first.unionByName(retry).unionByName(again)
