"""Stored results of the jobs (S3, S4, S6): segments, itemsets, rules and models.

The jobs write each table once under the shared folder; serving queries only
read.  A store belongs to one version of the input: its folder carries a digest
of the input files' names, lengths and times, so new data gets a new store and
a new session finds the old one.  Nothing is kept in the process.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import path_exists, shared_root

#: Raise when the jobs compute or lay out anything differently.
JOBS = 4
INPUTS = ("lineitem", "orders", "part", "customer", "nation")


def input_version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = INPUTS) -> str:
    """Digest of the input files as the file system lists them (names, lengths, times; never contents)."""
    jvm, listed = spark._jvm, [sf_dir.rstrip("/")]
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        listed += sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(path))
    return hashlib.sha256("\n".join(listed).encode()).hexdigest()[:16]


def write(df: DataFrame, path: str, by: str | None = None, **options: str) -> None:
    """Write a table; with ``by``, laid out for look-ups of single values of that column.

    Files hold ranges of the column and are sorted by it, so footers and page indexes leave out what a value cannot be in, and each row group has a
    Bloom filter of the column, for values that lie between others without being there."""
    writer = df.write
    if by:
        writer = df.repartitionByRange(by).sortWithinPartitions(by).write.option(f"parquet.bloom.filter.enabled#{by}", "true")
    writer.options(**options).mode("overwrite").parquet(path)


class Store:
    """Tables and models of one version of the input and one set of job parameters."""

    def __init__(self, spark: SparkSession, sf_dir: str, parameters: str = ""):
        self.spark = spark
        jobs = hashlib.sha256(f"{JOBS} {parameters}".encode()).hexdigest()[:8]
        self.path = f"{shared_root(spark)}/store/{input_version(spark, sf_dir)}-{jobs}"

    def has(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.path}/{name}/_SUCCESS")

    def table(self, name: str, job: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The stored table; the job runs only where no complete one is found.  ``by``: the column that rows are looked up by."""
        if not self.has(name):
            write(job(), f"{self.path}/{name}", by)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def model_path(self, name: str) -> str:
        return f"{self.path}/{name}"
