"""Clustering.

Two engines:

* ``FixedKMeansModel`` — Lloyd iterations in integer space (``z_milli`` columns),
  fully deterministic, so every downstream segment query has an exact SQL
  oracle.  ``N_INIT`` starts run side by side until each has converged (at most
  ``MAX_ITER`` iterations, else an error) and the one with the least inertia is
  kept.  An iteration is one pass over the cached point table: Arrow batches are
  assigned to the broadcast centres (starts x k small vectors) and give sums,
  so starts x k rows cross the shuffle per batch and only these reach the driver.
  The plan does not change with the centres.  Starts are seeded by k-means++
  (``initial_centres``).  Ties go to the lower centre, then the lower start; an
  empty cluster keeps its centre.
* ``train_kmeans`` — ``pyspark.ml.clustering.KMeans`` (k-means||) with
  restarts over seeds, the sweep over k with training cost and silhouette
  (``ClusteringEvaluator``: squared Euclidean, the metric Spark offers), and a
  ``PipelineModel`` (scaler and clusters) that is saved, loaded and scored with.

Cluster labels (M13) are derived from the centroid means in original units;
an explicit id -> label map can override them.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.scaling import ScalerModel, fit_scaler
from tillroll.session import materialize

N_INIT, MAX_ITER = 10, 300


def _milli(features: list[str]) -> list[str]:
    return [f"z_{f}_milli" for f in features]


def nearest_centre(zcols: list[str], centres: list[list]) -> Column:
    """Cluster id of the nearest centre (squared distance, ties -> lower id)."""
    options = []
    for j, c in enumerate(centres):
        terms = [(F.col(col) - F.lit(v)) * (F.col(col) - F.lit(v)) for col, v in zip(zcols, c)]
        options.append(F.struct(sum(terms[1:], terms[0]).alias("distance"), F.lit(j).alias("cluster")))
    return (options[0] if len(options) == 1 else F.least(*options))["cluster"].cast("int")


@dataclass
class FixedKMeansModel:
    features: list[str]
    scaler: ScalerModel
    centres: list[list[int]]
    iterations: int = 0
    converged: bool = False
    inertia: int = 0
    labels: dict[int, str] = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.centres)

    def assign(self, df: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
        """Scale ``df``'s raw feature columns and attach the nearest centre."""
        z = self.scaler.transform(df)
        out = z.withColumn(cluster_col, nearest_centre(_milli(self.features), self.centres))
        return out.drop(*[c for c in z.columns if c.startswith("z_")])

    def save(self, spark: SparkSession, path: str) -> None:
        """The model is a one-row JSON document written by Spark."""
        doc = json.dumps({"features": self.features, "means": self.scaler.means, "stds": self.scaler.stds,
                          "centres": self.centres, "labels": {str(k): v for k, v in self.labels.items()}})
        spark.createDataFrame([(doc,)], "model string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FixedKMeansModel":
        d = json.loads(spark.read.json(path).first()["model"])
        scaler = ScalerModel(d["features"], d["means"], d["stds"])
        return FixedKMeansModel(d["features"], scaler, d["centres"],
                                labels={int(k): v for k, v in d["labels"].items()})


def initial_centres(points: DataFrame, id_col: str, zcols: list[str], k: int, n_init: int) -> dict[int, list[list[int]]]:
    """k-means++ for all starts at once: one pass a centre, one point a start and pass reaches the driver.

    The first centre is a row drawn evenly, each further one a row drawn in proportion to the squared distance from the centres so far.  A draw is a
    race: the row with the least -ln(u) / weight wins, with u in (0, 1) from the first 52 bits of ``md5("start:place:id")``; ties go to the
    lesser id.  Where fewer than k points differ, a start has as many centres as there are points.
    """
    centres: dict[int, list[list[int]]] = {s: [] for s in range(n_init)}
    point = [F.col(id_col).cast("string").alias("id"), *[F.col(c) for c in zcols]]
    for j in range(k):
        going = [s for s, own in centres.items() if len(own) == j]
        if not going:
            break
        # One minimum a start over all rows, without groups: a task keeps a row a start.  A start's centres are one constant of the plan, so that
        # each place's code is compiled once.
        winners = []
        for s in going:
            own = F.lit([v for centre in centres[s] for v in centre]).cast("array<bigint>") if j else None
            h = F.md5(F.concat(F.lit(f"{s}:{j}:"), F.col("id")).cast("binary"))
            row = F.struct(h.alias("key"), "id", *zcols)
            if j:
                far = [sum(((F.col(c) - F.get(own, F.lit(m * len(zcols) + i))) * (F.col(c) - F.get(own, F.lit(m * len(zcols) + i)))
                            for i, c in enumerate(zcols)), F.lit(0).cast("bigint")) for m in range(j)]
                weight = far[0] if j == 1 else F.least(*far)
                u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
                row = F.when(weight > 0, F.struct((-F.log(u) / weight).alias("key"), "id", *zcols))
            winners.append(F.min(row).alias(str(s)))
        won = points.select(*point).agg(*winners).first()
        for s in going:
            if won[str(s)] is not None:
                centres[s].append([int(won[str(s)][c]) for c in zcols])
    return centres


def fit_fixed_kmeans(df: DataFrame, id_col: str, features: list[str], k: int = 4,
                     max_iter: int = MAX_ITER, n_init: int = N_INIT) -> FixedKMeansModel:
    scaler = fit_scaler(df, features)
    zcols = _milli(features)
    points = materialize(scaler.transform(df.select(id_col, *features)).select(id_col, *zcols),
                         keep_in_memory=True)
    try:
        return _lloyd(points, id_col, zcols, features, scaler, k, max_iter, n_init)
    finally:
        points.unpersist()


def _step(points: DataFrame, columns: list[str], centres: dict, whole: bool = True) -> dict[tuple, tuple]:
    """(start, cluster) -> members, 0, sums of the coordinates; (start, -1) -> 0, sum of squared distances, zeros.

    One pass for all starts.  A batch's distances to a start's centres are one matrix product (less the row's own square, which
    no comparison needs); so are the sums, by the matrix of memberships.  ``whole``: coordinates are integers and so are all
    results; products are exact in doubles below 2^53, and batches with greater coordinates are worked on in integers."""
    starts = list(centres)
    shared = points.sparkSession.sparkContext.broadcast([centres[s] for s in starts])
    kind = "long" if whole else "double"
    names = ["start", "cluster", "n", "cost", *columns]

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        exact = np.int64 if whole else np.float64
        lists = [np.array(own, exact) for own in shared.value]
        most = max((int(np.abs(c).max(initial=0)) for c in lists), default=0) if whole else 0
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            if not len(x):
                continue
            doubles = not whole or 4 * len(columns) * max(most, int(np.abs(x).max())) ** 2 < 1 << 53
            x = x.astype(np.float64 if doubles else np.int64, copy=False)
            square, across, ones = (x * x).sum(axis=1), np.ascontiguousarray(x.T), np.concatenate([np.ones((len(x), 1), x.dtype), x], axis=1)
            rows = []
            for s, own in enumerate(lists):
                c = own.astype(x.dtype, copy=False)
                far = (c * -2) @ across
                far += (c * c).sum(axis=1)[:, None]
                least, nearest = far[0].copy(), np.zeros(len(x), np.int16)
                for j in range(1, len(c)):
                    np.putmask(nearest, far[j] < least, j)  # ties stay with the lower centre
                    np.minimum(least, far[j], out=least)
                cost = np.maximum(square + least, 0).astype(exact, copy=False).sum()
                rows.append([s, -1, 0, cost, *[0] * len(columns)])
                total = (nearest == np.arange(len(c), dtype=np.int16)[:, None]).astype(x.dtype) @ ones
                rows += [[s, j, t[0], 0, *t[1:]] for j, t in enumerate(total) if t[0]]
            by_column = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64 if k < 3 else exact)) for k, v in enumerate(by_column)], names)

    schema = ", ".join(f"`{n}` {'long' if k < 3 else kind}" for k, n in enumerate(names))
    partial = points.select(*columns).mapInArrow(sums, schema)
    total = partial.groupBy("start", "cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)") if whole or c == "n" else F.col(c)).alias(c) for c in names[2:]])
    number = int if whole else float
    out = {(starts[r["start"]], r["cluster"]): (int(r["n"]), number(r["cost"]), [number(r[c]) for c in columns]) for r in total.collect()}
    shared.unpersist()
    return out


def _lloyd(points, id_col, zcols, features, scaler, k, max_iter, n_init) -> FixedKMeansModel:
    centres = initial_centres(points, id_col, zcols, k, n_init)
    if not centres or not centres[0]:
        return FixedKMeansModel(list(features), scaler, [], converged=True)
    open_, inertia, it = set(centres), {}, 0
    while open_ and it < max_iter:
        it += 1
        found = _step(points, zcols, {s: centres[s] for s in open_})
        for s in sorted(open_):
            inertia[s] = found[s, -1][1]
            new = [[v // found[s, j][0] for v in found[s, j][2]] if (s, j) in found else c for j, c in enumerate(centres[s])]
            if new == centres[s]:
                open_.discard(s)
            centres[s] = new
    if open_:
        raise RuntimeError(f"K-Means starts {sorted(open_)} have not converged after {max_iter} iterations")
    best = min(centres, key=lambda s: (inertia[s], s))
    return FixedKMeansModel(list(features), scaler, centres[best], iterations=it, converged=True, inertia=inertia[best])


def cluster_means(assigned: DataFrame, features: list[str], cluster_col: str = "Cluster",
                  exact: dict[str, str] | None = None) -> DataFrame:
    """A11 (unrounded): mean of every feature per cluster and the cluster size.

    ``exact`` maps features to a decimal type whose sum is exact (money), so
    means do not depend on summation order."""
    exact = exact or {}
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        x = F.col(f).cast(exact[f]) if f in exact else F.col(f)
        aggs.append((F.sum(x).cast("double") / F.count(x)).alias(f"mean_{f}"))
    return assigned.groupBy(cluster_col).agg(*aggs)


# ---------------------------------------------------------------- labelling --
def _rank(values: list[tuple[int, float]], descending: bool) -> dict[int, int]:
    """Competition rank (1 = best) of (id, value) pairs."""
    out = {}
    for cid, v in values:
        better = sum(1 for _, w in values if (w > v if descending else w < v))
        out[cid] = better + 1
    return out


def label_customer_clusters(means: list[dict]) -> dict[int, str]:
    """Lost = highest mean Recency; of the rest the best rank sum (Recency asc,
    Frequency desc, Monetary desc) is Champions, then Loyal, then At-Risk;
    ties by cluster id.  Any k other than 4 gets "Cluster n"."""
    if len(means) != 4:
        return {m["Cluster"]: f"Cluster {m['Cluster']}" for m in means}
    lost = sorted(means, key=lambda m: (-m["mean_Recency"], m["Cluster"]))[0]
    rest = [m for m in means if m is not lost]
    r = _rank([(m["Cluster"], m["mean_Recency"]) for m in rest], descending=False)
    f = _rank([(m["Cluster"], m["mean_Frequency"]) for m in rest], descending=True)
    mo = _rank([(m["Cluster"], m["mean_Monetary"]) for m in rest], descending=True)
    order = sorted(rest, key=lambda m: (r[m["Cluster"]] + f[m["Cluster"]] + mo[m["Cluster"]], m["Cluster"]))
    labels = {lost["Cluster"]: "Lost"}
    for m, name in zip(order, ["Champions", "Loyal", "At-Risk"]):
        labels[m["Cluster"]] = name
    return labels


def label_product_clusters(means: list[dict]) -> dict[int, str]:
    """Premium = highest avg_price; of the rest Trending = highest
    total_quantity (then num_transactions); of the rest Niche = lowest
    num_transactions (then num_customers); the last is Budget."""
    if len(means) != 4:
        return {m["Cluster"]: f"Cluster {m['Cluster']}" for m in means}
    pool = list(means)
    premium = sorted(pool, key=lambda m: (-m["mean_avg_price"], m["Cluster"]))[0]
    pool.remove(premium)
    trending = sorted(pool, key=lambda m: (-m["mean_total_quantity"], -m["mean_num_transactions"],
                                           m["Cluster"]))[0]
    pool.remove(trending)
    niche = sorted(pool, key=lambda m: (m["mean_num_transactions"], m["mean_num_customers"], m["Cluster"]))[0]
    pool.remove(niche)
    labels = {premium["Cluster"]: "Premium", trending["Cluster"]: "Trending", niche["Cluster"]: "Niche"}
    labels[pool[0]["Cluster"]] = "Budget"
    return labels


def attach_labels(assigned: DataFrame, spark: SparkSession, labels: dict[int, str],
                  cluster_col: str = "Cluster") -> DataFrame:
    """Left join to the k-row label table (broadcast); unknown ids -> "Cluster n"."""
    dim = spark.createDataFrame(sorted(labels.items()) or [(-1, "")], f"{cluster_col} int, _label string")
    return (assigned.join(F.broadcast(dim), cluster_col, "left")
            .withColumn("Segment", F.coalesce("_label", F.concat(F.lit("Cluster "), F.col(cluster_col).cast("string"))))
            .drop("_label"))


def segment(df: DataFrame, id_col: str, features: list[str], kind: str, k: int = 4, max_iter: int = MAX_ITER,
            money: dict[str, str] | None = None,
            labels: dict[int, str] | None = None) -> tuple[DataFrame, FixedKMeansModel]:
    """Fit the fixed K-Means, assign every row, label the clusters.

    Returns ``df`` + ``Cluster`` + ``Segment`` and the model (with its labels)."""
    model = fit_fixed_kmeans(df, id_col, features, k, max_iter)
    assigned = model.assign(df)
    if labels is None:
        means = [r.asDict() for r in cluster_means(assigned, features, exact=money).collect()]  # k rows
        labels = label_customer_clusters(means) if kind == "customer" else label_product_clusters(means)
    model.labels = dict(labels)
    return attach_labels(assigned, df.sparkSession, labels), model


# ------------------------------------------------------------ trained model --
def _vector_pipeline(df: DataFrame, features: list[str], ddof: int = 0):
    """Fitted scaling stages.  Spark's ``StandardScaler`` divides by the sample
    deviation; ``SQLTransformer`` writes out the population form (``ddof=0``) and is
    saved with the pipeline like any stage."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    scaler = fit_scaler(df, features, ddof, grid=False)
    scaled = [f"(CAST(`{f}` AS DOUBLE) - {m!r}D) / {s!r}D AS `_z_{f}`" if s else f"0D AS `_z_{f}`"
              for f, m, s in zip(features, scaler.means, scaler.stds)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
              VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="features")]
    return Pipeline(stages=stages).fit(df)


def _fit_restarts(vectors: DataFrame, columns: list[str], specs: list[tuple[int, int]], max_iter: int, tol: float,
                  workers: int) -> dict[tuple[int, int], tuple[list[list[float]], float]]:
    """(k, seed) -> centres and training cost of one K-Means each.

    ``pyspark.ml`` draws the starts (k-means||, ``maxIter=0``; a small driver thread pool submits these independent jobs).
    The iterations of all fits run side by side, one pass over the cached rows for each, by the rules of ``pyspark.ml``:
    an empty cluster keeps its centre, a fit ends when no centre has moved by more than ``tol``, and its cost is
    that of the last pass's assignment."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans

    def start(spec):
        k, s = spec
        model = KMeans(k=k, seed=s, maxIter=0, featuresCol="features", predictionCol="Cluster").fit(vectors)
        return spec, [[float(v) for v in c] for c in model.clusterCenters()]

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        centres = dict(pool.map(start, specs))
    open_, cost, it = list(specs), {}, 0
    while open_ and it < max_iter:
        it += 1
        found, still = _step(vectors, columns, {s: centres[s] for s in open_}, whole=False), []
        for s in open_:
            cost[s] = found[s, -1][1]
            new = [[v / found[s, j][0] for v in found[s, j][2]] if (s, j) in found else c for j, c in enumerate(centres[s])]
            if any(sum((a - b) ** 2 for a, b in zip(x, y)) > tol * tol for x, y in zip(new, centres[s])):
                still.append(s)
            centres[s] = new
        open_ = still
    return {s: (centres[s], cost[s]) for s in specs}


#: Training costs that differ by less, relatively, are equal: sums of doubles in another order.
SAME_COST = 1e-9


def _best(fits: dict, k: int) -> int:
    """Seed of the least training cost, ties to the lower seed."""
    own = {s: cost for (n, s), (_, cost) in fits.items() if n == k}
    return min(s for s, cost in own.items() if cost <= min(own.values()) * (1 + SAME_COST))


def _scaled_vectors(scaler_model, df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows' vectors and the same numbers as columns, cached for all fits."""
    columns = [f"_z_{f}" for f in features]
    return scaler_model.transform(df).select("features", *columns).cache(), columns


def train_kmeans(df: DataFrame, features: list[str], k: int = 4, seed: int = 42, n_init: int = 10,
                 max_iter: int = 300, tol: float = 1e-4, workers: int = 8):
    """M5: scaler + K-Means pipeline; restarts use seeds seed..seed+n_init-1 and
    keep the lowest training cost (ties: lower seed).  The scaled vector table
    is cached once and shared by all restarts; the best one is then fitted by
    ``pyspark.ml`` from start to end.  Returns (PipelineModel, cost)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import KMeans

    scaler_model = _vector_pipeline(df, features)
    vectors, columns = _scaled_vectors(scaler_model, df, features)
    try:
        fits = _fit_restarts(vectors, columns, [(k, s) for s in range(seed, seed + n_init)], max_iter, tol, workers)
        best = KMeans(k=k, seed=_best(fits, k), maxIter=max_iter, tol=tol, featuresCol="features", predictionCol="Cluster").fit(vectors)
        cost = best.summary.trainingCost
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*scaler_model.stages, best]), cost


def k_sweep(df: DataFrame, features: list[str], ks=range(2, 11), seed: int = 42, n_init: int = 10,
            max_iter: int = 300, tol: float = 1e-4, workers: int = 8) -> DataFrame:
    """M4: (k, inertia, silhouette) per k — inertia = best training cost over
    the restarts, silhouette from ``ClusteringEvaluator`` (squared Euclidean)
    on that best model's assignment."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    scaler_model = _vector_pipeline(df, features)
    vectors, columns = _scaled_vectors(scaler_model, df, features)
    try:
        specs = [(k, s) for k in ks for s in range(seed, seed + n_init)]
        fits = _fit_restarts(vectors, columns, specs, max_iter, tol, workers)
        rows = []
        for k in ks:
            centres, cost = fits[k, _best(fits, k)]
            sil = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster").evaluate(
                vectors.select("features", nearest_centre(columns, centres).alias("Cluster")))
            rows.append((int(k), float(cost), float(sil)))
    finally:
        vectors.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def save_pipeline(model, path: str) -> None:
    """Scaler and clusters as one ``PipelineModel``."""
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def score_trained(model, df: DataFrame, features: list[str], kind: str, money: dict[str, str] | None = None) -> DataFrame:
    """Rows with the trained model's Cluster and, by the same rules as the fixed engine's, Segment."""
    assigned = model.transform(df).select(*df.columns, F.col("Cluster").cast("int").alias("Cluster"))
    means = [r.asDict() for r in cluster_means(assigned, features, exact=money).collect()]  # k rows
    labels = label_customer_clusters(means) if kind == "customer" else label_product_clusters(means)
    return attach_labels(assigned, df.sparkSession, labels)


def trained_invariants(model, df: DataFrame, cost: float) -> DataFrame:
    """What must hold for any trained model: each row's centre is the nearest one, and the
    training cost is the sum of the squared distances to it.  One row: n_rows, n_clusters,
    n_not_nearest, inertia_holds."""
    from pyspark.ml.functions import vector_to_array

    centres = [[float(v) for v in c] for c in model.stages[-1].clusterCenters()]
    x = model.transform(df).select("Cluster", vector_to_array("features").alias("x"))
    distance = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b) for c in centres]
    d = x.select("Cluster", F.array(*distance).alias("d"))
    own = F.element_at("d", F.col("Cluster") + 1)
    out = d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(own > F.array_min("d") + 1e-9).alias("n_not_nearest"), F.sum(own).alias("cost"))
    return out.select("n_rows", F.lit(len(centres)).cast("bigint").alias("n_clusters"), "n_not_nearest",
                      (F.abs(F.col("cost") - F.lit(float(cost))) <= 1e-6 * F.greatest(F.lit(1.0), F.col("cost"))).alias("inertia_holds"))
