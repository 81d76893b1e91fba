"""Numbered folders of which only complete ones count: a table's versions, a stream's batches."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import path_exists


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``<prefix>=<number>`` in a folder, ascending."""
    if not path_exists(spark, path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = [s.getPath().getName() for s in listed]
    found = sorted(int(n[len(prefix) + 1:]) for n in names if n.startswith(f"{prefix}=") and n[len(prefix) + 1:].isdigit())
    return [n for n in found if path_exists(spark, f"{path}/{prefix}={n}/_SUCCESS")]


class Versions:
    """Versions of one table; readers get the latest complete one whenever they ask."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, df: DataFrame) -> int:
        number = max(numbered(self.spark, self.path, "version"), default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        return number

    def latest(self) -> DataFrame:
        known = numbered(self.spark, self.path, "version")
        if not known:
            raise FileNotFoundError(f"no complete version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/version={known[-1]}")
