"""Silhouette of a clustering by Euclidean distance (M6), exact up to ``SAMPLE`` rows, on a sample beyond.

The mean distance of a row to every cluster needs all pairs of rows.  So the rows are a bounded sample, the first by hash of
the id (all rows where the table is no larger; ``n_sampled`` says how many).  The sample is broadcast, at most
``sample`` small vectors, and its rows are dealt to tasks, which sum distances by cluster in blocks; no pair becomes a row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, BLOCK = 4000, 256


def silhouettes(assigned: DataFrame, id_col: str, columns: list[str], cluster_col: str = "Cluster", sample: int = SAMPLE) -> DataFrame:
    """One row: n_rows, n_sampled, euclidean and squared, the mean silhouettes by distance and by squared distance.

    ``columns`` are numbers without nulls; rows without a cluster or an id are left out.  A row alone in its cluster has silhouette 0, as does one at no distance from
    all others; with fewer than two clusters in the sample the silhouettes are null.  Repeated rows are rows of their own.
    """
    import numpy as np

    spark = assigned.sparkSession
    rows = assigned.filter(F.col(cluster_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(cluster_col).cast("int").alias("c"), *[F.col(c).cast("double").alias(c) for c in columns])
    taken = rows.orderBy(F.md5(F.col("id").cast("binary")), "id", *columns).limit(sample)
    local = taken.select("c", *columns).toArrow()  # at most ``sample`` rows
    clusters, own = np.unique(local.column("c").to_numpy(), return_inverse=True)
    points = np.stack([local.column(c).to_numpy() for c in columns], axis=1) if len(own) else np.zeros((0, len(columns)))
    shared = spark.sparkContext.broadcast((points, own, np.bincount(own, minlength=len(clusters)).astype(float)))

    def sums(batches):
        import pyarrow as pa

        points, own, sizes = shared.value
        member = np.eye(len(sizes))[own]
        for batch in batches:
            at = batch.column("at").to_numpy()
            total = np.zeros(2)
            for some in np.array_split(at, range(BLOCK, len(at), BLOCK)):
                squared = sum((points[some, k][:, None] - points[:, k][None, :]) ** 2 for k in range(points.shape[1]))
                for form, distance in enumerate((np.sqrt(squared), squared)):
                    by_cluster = distance @ member
                    mine = np.arange(len(some)), own[some]
                    inner = by_cluster[mine] / np.maximum(1, sizes[own[some]] - 1)
                    means = by_cluster / sizes
                    means[mine] = np.inf
                    outer = means.min(axis=1)
                    most = np.maximum(inner, outer)
                    value = np.where((sizes[own[some]] > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0.0)
                    total[form] += value.sum()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], ["euclidean", "squared"])

    whole = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    if len(clusters) < 2:
        mean = [F.lit(None).cast("double").alias(c) for c in ("euclidean", "squared")]
        return whole.select("n_rows", F.lit(len(own)).cast("bigint").alias("n_sampled"), *mean)
    places = spark.range(0, len(own), 1, max(1, min(len(own) // BLOCK, spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "at")
    found = places.mapInArrow(sums, "euclidean double, squared double").agg(*[(F.sum(c) / len(own)).alias(c) for c in ("euclidean", "squared")])
    pick = found.first()
    return whole.select("n_rows", F.lit(len(own)).cast("bigint").alias("n_sampled"), F.lit(pick["euclidean"]).alias("euclidean"), F.lit(pick["squared"]).alias("squared"))
