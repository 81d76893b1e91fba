"""Tables that micro-batches keep up to date (T1–T3 run continuously).

Every micro-batch is written once to a folder that carries its number.  A batch that the engine replays after a stop finds its folder
complete and changes nothing; a folder without ``_SUCCESS`` was left by a lost driver and is overwritten.  Readers take
complete folders only and see one row a key: that of the latest batch.  ``compact`` folds the batches so
far into one folder, so that reading does not slow down with the number of batches; the folder is complete before it counts.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import checkpoint_root
from tillroll.sources.versions import Versions, numbered  # noqa: F401 (Versions re-exported)


class UpsertTable:
    """One row a key, kept up to date by numbered batches.

    ``order`` says which of a batch's rows with one key counts: the one with the greatest values, ties by the row's hash.
    Null keys are a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], order: list[str] = ()):
        self.spark, self.path, self.key, self.order = spark, path, list(key), list(order)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _newest(self, df: DataFrame, order: list[str]) -> DataFrame:
        """The key's row with the greatest order; map-side, so that a key with many rows ships one a task."""
        names = self.schema.fieldNames()
        rest = F.struct(*[F.col(c) for c in names if c not in self.key])
        rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*names))
        out = df.groupBy(*self.key).agg(F.max_by(rest, rank).alias("_row"))
        return out.select(*[F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in names])

    def _state(self) -> tuple[int, list[int]]:
        """The last batch that the latest snapshot holds (-1: none), and the complete batches after it."""
        upto = max(numbered(self.spark, f"{self.path}/snapshots", "upto"), default=-1)
        return upto, [n for n in numbered(self.spark, f"{self.path}/batches", "batch") if n > upto]

    def write_batch(self, batch: DataFrame, number: int) -> bool:
        """Write a batch unless it is there already; says whether it was written."""
        upto, known = self._state()
        if number <= upto or number in known:
            return False
        self._newest(batch, self.order).write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        return True

    def read(self) -> DataFrame:
        """The current rows, as of the batches complete now."""
        upto, known = self._state()
        parts = [(upto, f"{self.path}/snapshots/upto={upto}")] * (upto >= 0) + [(n, f"{self.path}/batches/batch={n}") for n in known]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        # One scan of all folders; a file's batch is the number in its folder's name.
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:batch|upto)=(\d+)/[^/]*$", 1).cast("long")
        rows = self.spark.read.schema(self.schema).parquet(*[p for _, p in parts]).select("*", number.alias("_batch"))
        return self._newest(rows, ["_batch"])

    def compact(self) -> int:
        """Fold all complete batches into a snapshot; returns the last batch it holds (-1: there is none)."""
        upto, known = self._state()
        if not known:
            return upto
        self.read().write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={known[-1]}")
        return known[-1]


def run_upserts(df: DataFrame, table: UpsertTable, base: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
                output_mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over what is there now, batch by batch, into the table; returns the table's rows.

    ``transform`` is called for each micro-batch, so what it reads (a model, a table of segments) is as of that batch.
    A later call with the same ``base`` goes on from the checkpoint there.
    """
    start_upserts(df, table, base, transform, output_mode).awaitTermination()
    return table.read()


def start_upserts(df: DataFrame, table: UpsertTable, base: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
                  output_mode: str = "append", processing_time: str | None = None):
    """Continuous form of ``run_upserts`` when ``processing_time`` (``30 seconds``) is given; returns the running query."""
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (df.writeStream.outputMode(output_mode).option("checkpointLocation", f"{base}/_checkpoint")
            .foreachBatch(lambda batch, number: table.write_batch(transform(batch), number) and None).trigger(**trigger).start())


def stream_base(spark: SparkSession, name: str) -> str:
    """A new folder of a stream among this session's run files."""
    return f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"
