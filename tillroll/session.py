"""Session defaults and lineage helpers.

Everything here is ordinary SparkSession configuration; the library never
re-implements planning or storage.  On a cluster the session is created by the
platform, must name a shared folder in ``spark.checkpoint.dir``, and only the
helpers below ``get_spark`` are used.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter for the jobs in this package.  AQE coalesces the many
# small post-aggregation partitions and splits skewed join partitions at run
# time; the broadcast threshold is Spark's own size check for dimension joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # streaming aggregation state off-heap in RocksDB instead of executor heap maps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillroll") -> SparkSession:
    """Local/test session.  ``master`` defaults to ``local[$BENCH_CPUS or 8]``."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, the same for every session.

    Only a local master may go without one: it gets a scratch folder.  On any
    other master executors would write to their own disks, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _scratch
    _scratch = _scratch or tempfile.mkdtemp(prefix="tillroll-")
    return _scratch


_scratch: str | None = None  # a folder's name, for local masters only


def checkpoint_root(spark: SparkSession) -> str:
    """Folder of this session's run files inside the shared folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(spark))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_root(spark)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def materialize(df: DataFrame, keep_in_memory: bool = False) -> DataFrame:
    """Write a table that several later jobs reuse, once, as Parquet in the shared
    folder, and return its scan: lineage is cut, later readers prune columns and
    rows, and a lost executor costs a reread.  With ``keep_in_memory=True``
    (tight loops that unpersist when done) the scan is also cached; lost blocks
    are read again from the files."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if keep_in_memory else out


#: Bytes of input files behind one task of ``dealt``, the most tasks by that rule, and the bytes a task gets where it gives too few.
DEAL_BYTES, DEAL_TASKS, DEAL_MOST = 4 << 20, 200, 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Total length of the files that a table is read from, as the file system gives it."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def tasks_for(size: int) -> int:
    """Tasks that input files of this length are dealt over."""
    return max(min(DEAL_TASKS, -(-size // DEAL_BYTES)), -(-size // DEAL_MOST))


#: Parts that ``dealt`` splits the rows of one value of the first keys into.
DEAL_PARTS = 8


def dealt(df: DataFrame, owner: list[str], keys: list[str]) -> DataFrame:
    """Rows dealt by ``owner`` and one of ``DEAL_PARTS`` parts by the other keys (column ``_part``), over a number of tasks that grows with
    the input's files: for an aggregation by ``[*owner, "_part", *keys]``, which then needs no shuffle, and one by ``owner`` after it,
    which gets at most ``DEAL_PARTS`` rows an owner.

    Meant for keys that are mostly different: there a partial aggregation holds nearly all rows of a task that reads the
    input in one map, which grows with the files' splits, spills, and sends hardly fewer rows on.  Up to ``DEAL_TASKS`` tasks the
    shuffle writes straight to its files, without a buffer to sort in."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, tasks_for(input_bytes(df)))
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(DEAL_PARTS)).cast("int")).repartition(n, *owner, "_part")


def clear_run_files(spark: SparkSession) -> None:
    """Delete the tables and streams that this session's queries have written.
    Results that still read them must have been consumed."""
    for name in ("tables", "streams"):
        delete_path(spark, f"{checkpoint_root(spark)}/{name}")


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once a context, as ``--py-files`` would.

    Functions inside tasks are then found wherever the driver was started from."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tillroll_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tillroll-py-"), "tillroll.zip")  # the driver serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tillroll", os.path.relpath(full, home)))
    sc.addPyFile(path)
    sc._tillroll_shipped = True
