"""Structured Streaming jobs (T1–T3) over the order event feed.

The reference's dashboards poll static results and one endpoint invents an
order; here the orders are a real stream: ``purchase`` events read with
``readStream``.  Results go to a Parquet sink in the shared checkpoint folder
(``spark.checkpoint.dir``) together with the query's own checkpoint; a query
started again with the same ``base`` folder resumes where it stopped.  ``run_to_table`` drives a
query with ``availableNow`` (process what is there, then stop) — the same
code runs continuously with ``trigger(processingTime=...)``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import DEAL_BYTES, DEAL_TASKS, checkpoint_root, input_bytes

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def utc_instant(wall) -> Column:
    """The instant at which UTC clocks show a timestamp_ntz, whatever the session's zone."""
    return F.from_utc_timestamp(wall.cast("timestamp"), F.current_timezone())


def utc_wall(instant) -> Column:
    """What UTC clocks show at an instant, as timestamp_ntz."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def order_stream(spark: SparkSession, path: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Purchase events as orders: (order_id, customer_id, amount, ts timestamp).

    ``path`` is the folder new event files land in (``glob`` selects files in
    it); ``ts`` is turned from timestamp_ntz (UTC) to a timestamp
    because watermarks need the latter."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(path)
    return (ev.filter(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("order_id"), F.col("user_id").cast("string").alias("customer_id"),
                    F.col("value").alias("amount"), utc_instant(F.col("ts")).alias("ts")))


def without_repeats(orders: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Orders whose id was not seen within the watermark: events that the feed delivers again count once.

    State holds the ids of one watermark's time, not all; an order that comes again later than that is behind the watermark and late."""
    return orders.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["order_id"])


def open_kpis(orders: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """T1 as the dashboard shows it: windows that are still open too, for update mode, and repeated orders once."""
    return _kpis(without_repeats(orders, watermark), window)


def live_kpis(orders: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Orders, amount and mean amount per tumbling event-time window.
    Append mode: a window is emitted once the watermark passes its end; state
    of older windows is dropped.  Amounts are summed as decimals (exact)."""
    return _kpis(orders.withWatermark("ts", watermark), window)


def _kpis(orders: DataFrame, window: str) -> DataFrame:
    money = F.col("amount").cast("decimal(18,2)")
    agg = orders.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("orders"), F.sum(money).alias("_amount"))
    return agg.select(
        utc_wall(F.col("window.start")).alias("window_start"),
        utc_wall(F.col("window.end")).alias("window_end"),
        "orders",
        F.col("_amount").cast("double").alias("amount"),
        (F.col("_amount").cast("double") / F.col("orders")).alias("avg_amount"))


#: Rows of a hot customer are spread over this many join keys; bytes of the segment table's files behind one of the join's first ``DEAL_TASKS`` tasks.
SALT, SEGMENT_BYTES = 8, 1 << 18


def enrich_orders(orders: DataFrame, customers_segmented: DataFrame, actions: DataFrame) -> DataFrame:
    """Stream-static left join of each order to its customer's segment and
    the segment's marketing action.  A streaming join is not split at run time, so the
    key is salted: the segment table (a narrow row a customer) is repeated ``SALT`` times, over a number of tasks that grows with its
    files, and hashed, so that a task's memory neither grows with the customers nor with the orders, which pass by unsorted.  The
    4-row action table is broadcast."""
    size = input_bytes(customers_segmented)
    n = max(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(DEAL_TASKS, -(-size // SEGMENT_BYTES)), -(-size // DEAL_BYTES))
    key = ["customer_id", "_salt"]
    seg = customers_segmented.select(F.col("CustomerID").alias("customer_id"), "Segment",
                                     F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")).repartition(n, *key)
    act = F.broadcast(actions.select("Segment", "action"))
    salted = orders.withColumn("_salt", F.pmod(F.xxhash64("order_id"), F.lit(SALT)).cast("int")).repartition(n, *key)
    return (salted.join(seg.hint("shuffle_hash"), key, "left").join(act, "Segment", "left")
            .select("order_id", "customer_id", utc_wall(F.col("ts")).alias("ts"), "amount",
                    F.coalesce("Segment", F.lit("Unknown")).alias("customer_segment"),
                    F.coalesce("action", F.lit("")).alias("marketing_action")))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append",
                 base: str | None = None) -> DataFrame:
    """Run a streaming DataFrame to completion on the data present now and
    return the sink as a batch DataFrame."""
    spark = df.sparkSession
    root = base or f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", f"{root}/_checkpoint")
         .option("path", f"{root}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/data")


def start_stream(df: DataFrame, name: str, output_mode: str = "append",
                 processing_time: str = "30 seconds", base: str | None = None):
    """Continuous form of ``run_to_table``: the dashboards' 30-second refresh
    becomes a micro-batch trigger.  Returns the running ``StreamingQuery``."""
    spark = df.sparkSession
    root = base or f"{checkpoint_root(spark)}/streams/{name}"
    return (df.writeStream.format("parquet").outputMode(output_mode)
            .option("checkpointLocation", f"{root}/_checkpoint")
            .option("path", f"{root}/data")
            .queryName(name)
            .trigger(processingTime=processing_time).start())


def score_stream(rows: DataFrame, model, spark: SparkSession, kind: str) -> DataFrame:
    """Micro-batch scoring — each micro-batch of feature rows is assigned to
    the saved centres and labelled (pure column expressions, stateless)."""
    from tillroll.operators.segments import score
    return score(spark, model.assign(rows), kind, model.labels)
