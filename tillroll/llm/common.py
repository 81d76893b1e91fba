"""Helpers shared by the operators: row packing, Arrow slices, written tables.

Row-wise operators return the input's columns inside one struct column
``row`` and their own results beside it, so no name of the input can clash
with a result.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import checkpoint_root, ship_package

#: Bytes of text a Python worker handles at a time (a single longer text goes alone).
SLICE_BYTES = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, text: str, keep: Iterable[str] | None = None) -> DataFrame:
    """Columns ``row`` (struct of the kept columns, all by default) and ``text``."""
    ship_package(df.sparkSession)
    names = df.columns if keep is None else list(keep)
    return df.select(F.struct(*[col(c).alias(c) for c in names]).alias("row"),
                     col(text).cast("string").alias("text"))


def row_type(df: DataFrame, keep: Iterable[str] | None = None) -> str:
    """DDL of the ``row`` column that ``packed`` makes."""
    return packed(df, df.columns[0], keep).schema["row"].dataType.simpleString()


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files of a finished write are of no use: have Spark drop them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class RunFolder:
    """Tables of one operator run, in the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts lineage: executors lost later cost only the files' rereading.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        with _shuffle_cleanup(self.spark):
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table of this run that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; a null has no bytes."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts(array: pa.Array) -> Iterator[bytes]:
    """Each text of a string column as UTF-8 bytes (null: empty)."""
    off, data = column_bytes(array)
    view = memoryview(data)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield bytes(view[a:b])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text."""
    off, _ = column_bytes(batch.column(column))
    off, start = off - off[0], 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def per_text(df: DataFrame, make, result: str, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """``row`` plus the columns that ``make()`` returns for a slice of texts.

    ``make`` runs once a task and returns a function from a list of byte strings
    to a dict of Arrow arrays; ``result`` is the DDL of these columns.
    """
    source = packed(df, text, keep)
    out = f"row {source.schema['row'].dataType.simpleString()}, {result}"

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch):
                got = work(list(texts(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("row"), *got.values()], ["row", *got])

    return source.mapInArrow(run, out)
