"""Reading and writing tables.

Reads always name their columns so the Parquet scan only decodes what the job
uses (``ReadSchema`` in the plan); filters written after a read are pushed into
the scan by Catalyst.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


# Schemas of the artefacts the jobs exchange (S3).  Only the listed columns are
# read; other columns in a file are ignored.
RULES_SCHEMA = "antecedents_str string, consequents_str string, support double, confidence double, lift double"
CUSTOMERS_SCHEMA = ("CustomerID string, Frequency bigint, Monetary double, Recency int, "
                    "Cluster int, Segment string")
PRODUCTS_SCHEMA = ("Description string, avg_price double, total_quantity bigint, num_transactions bigint, "
                   "num_customers bigint, total_revenue double, Cluster int, Segment string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data)."""
    return (spark.read.option("header", True).option("enforceSchema", False)
            .schema(schema).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Overwrite a table; parent folders are created by the writer."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """One ``(table, rows)`` row per table; each count is a distributed aggregate."""
    parts = [df.select(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
             for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)
