"""Invariants of the deterministic K-Means and labelling."""
import re

import pytest

from tillroll.operators import kmeans as K
from tillroll.plans import catalog as C
from conftest import SF0001


def test_fixed_kmeans_invariants(spark):
    r = C.rfm(spark, SF0001)
    model = K.fit_fixed_kmeans(r, "CustomerID", ["Recency", "Frequency", "Monetary"], k=4, n_init=3)
    z = model.scaler.transform(r).collect()
    cols = [f"z_{f}_milli" for f in model.features]
    sizes = {}
    for row in z:
        d = [sum((row[c] - v) ** 2 for c, v in zip(cols, cen)) for cen in model.centres]
        best = min(range(len(d)), key=lambda j: (d[j], j))
        sizes[best] = sizes.get(best, 0) + 1
    assigned = {row.CustomerID: row.Cluster for row in model.assign(r).collect()}
    for row in z:
        d = [sum((row[c] - v) ** 2 for c, v in zip(cols, cen)) for cen in model.centres]
        assert assigned[row.CustomerID] == min(range(len(d)), key=lambda j: (d[j], j))
    assert model.converged  # a fixed point: every centre is the floor-mean of its members
    for j, cen in enumerate(model.centres):
        members = [row for row in z if assigned[row.CustomerID] == j]
        if members:
            assert cen == [sum(m[c] for m in members) // len(members) for c in cols]
    own = [min(sum((row[c] - v) ** 2 for c, v in zip(cols, cen)) for cen in model.centres) for row in z]
    assert model.inertia == sum(own)
    again = K.fit_fixed_kmeans(r, "CustomerID", ["Recency", "Frequency", "Monetary"], k=4, n_init=3)
    assert again.centres == model.centres


def test_labels_cover_segments():
    means = [
        {"Cluster": 0, "mean_Recency": 10.0, "mean_Frequency": 9.0, "mean_Monetary": 900.0},
        {"Cluster": 1, "mean_Recency": 300.0, "mean_Frequency": 1.0, "mean_Monetary": 50.0},
        {"Cluster": 2, "mean_Recency": 40.0, "mean_Frequency": 4.0, "mean_Monetary": 300.0},
        {"Cluster": 3, "mean_Recency": 120.0, "mean_Frequency": 2.0, "mean_Monetary": 100.0},
    ]
    assert K.label_customer_clusters(means) == {0: "Champions", 1: "Lost", 2: "Loyal", 3: "At-Risk"}
    assert K.label_customer_clusters(means[:3]) == {0: "Cluster 0", 1: "Cluster 1", 2: "Cluster 2"}
    pm = [{"Cluster": i, "mean_avg_price": p, "mean_total_quantity": q, "mean_num_transactions": t,
           "mean_num_customers": c} for i, (p, q, t, c) in
          enumerate([(2.0, 500, 50, 40), (50.0, 100, 20, 15), (3.0, 9000, 400, 300), (4.0, 300, 5, 3)])]
    assert K.label_product_clusters(pm) == {0: "Budget", 1: "Premium", 2: "Trending", 3: "Niche"}


def test_trained_kmeans_assigns_nearest(spark):
    r = C.rfm(spark, SF0001)
    model, cost = K.train_kmeans(r, ["Recency", "Frequency", "Monetary"], k=3, n_init=2, workers=2)
    km = model.stages[-1]
    centers = km.clusterCenters()
    pred = model.transform(r).select("features", "Cluster").collect()
    for row in pred:
        v = row.features.toArray()
        d = [float(((v - c) ** 2).sum()) for c in centers]
        assert row.Cluster == min(range(len(d)), key=d.__getitem__)
    assert cost == km.summary.trainingCost


def test_model_save_load(spark, tmp_path):
    r = C.rfm(spark, SF0001)
    seg, model = K.segment(r, "CustomerID", ["Recency", "Frequency", "Monetary"], "customer", 4,
                           money={"Monetary": "decimal(28,2)"})
    model.save(spark, str(tmp_path / "m"))
    back = K.FixedKMeansModel.load(spark, str(tmp_path / "m"))
    assert back.centres == model.centres and back.labels == model.labels
    a = {x.CustomerID: x.Cluster for x in model.assign(r).collect()}
    b = {x.CustomerID: x.Cluster for x in back.assign(r).collect()}
    assert a == b
    assert {x.Segment for x in seg.select("Segment").distinct().collect()} <= {"Champions", "Loyal", "At-Risk", "Lost"}


def test_k_sweep_rows(spark):
    r = C.rfm(spark, SF0001)
    rows = K.k_sweep(r, ["Recency", "Frequency", "Monetary"], ks=[2, 3], n_init=2, max_iter=20, workers=4).collect()
    assert [x.k for x in rows] == [2, 3]
    assert all(0.0 < x.inertia < float("inf") for x in rows)
    assert all(-1.0 <= x.silhouette <= 1.0 for x in rows)


def test_more_starts_never_worse_and_limit_is_an_error(spark):
    r = C.rfm(spark, SF0001)
    f = ["Recency", "Frequency", "Monetary"]
    one, many = (K.fit_fixed_kmeans(r, "CustomerID", f, k=20, n_init=n) for n in (1, 4))
    assert len(many.centres) == 20 and many.inertia <= one.inertia
    with pytest.raises(RuntimeError):
        K.fit_fixed_kmeans(r, "CustomerID", f, k=4, n_init=2, max_iter=1)


def test_repeated_and_few_points(spark):
    df = spark.createDataFrame([(str(i), float(i % 2)) for i in range(50)], "id string, x double")
    model = K.fit_fixed_kmeans(df, "id", ["x"], k=4, n_init=2)
    assert model.converged and len(model.centres) == 2 and model.inertia == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_product_model_converges(spark, sf):
    model = K.fit_fixed_kmeans(C.product_features(spark, sf), "Description", list(C.FE.PRODUCT_FEATURES))
    assert model.converged and len(model.centres) == 4


def test_trained_pipeline_is_saved_labelled_and_scaled_by_population_deviation(spark, tmp_path):
    r = C.rfm(spark, SF0001)
    f = ["Recency", "Frequency", "Monetary"]
    model, cost = K.train_kmeans(r, f, k=4, n_init=2, workers=2)
    K.save_pipeline(model, str(tmp_path / "p"))
    back = K.load_pipeline(str(tmp_path / "p"))
    scored = K.score_trained(back, r, f, "customer", {"Monetary": "decimal(28,2)"})
    assert {x.Segment for x in scored.select("Segment").distinct().collect()} == {"Champions", "Loyal", "At-Risk", "Lost"}
    one = K.trained_invariants(back, r, cost).first()
    assert (one.n_rows, one.n_clusters, one.n_not_nearest, one.inertia_holds) == (r.count(), 4, 0, True)
    z = [v.features.toArray() for v in back.transform(r).select("features").collect()]
    n = len(z)
    for k in range(3):
        assert abs(sum(v[k] for v in z)) < 1e-6 and abs(sum(v[k] ** 2 for v in z) / n - 1) < 1e-9


def _seeds_by_hand(rows, k, n_init):
    """k-means++ by the same draws, in plain Python over (id, point)."""
    import hashlib
    import math
    out = {}
    for s in range(n_init):
        own = []
        for j in range(k):
            digest = lambda i: hashlib.md5(f"{s}:{j}:{i}".encode()).hexdigest()
            if not own:
                own.append(min((digest(i), i, p) for i, p in rows)[2])
                continue
            race = []
            for i, p in rows:
                d = min(sum((a - b) ** 2 for a, b in zip(p, c)) for c in own)
                if d:
                    race.append((-math.log((int(digest(i)[:13], 16) + 0.5) / 2 ** 52) / d, i, p))
            if race:
                own.append(min(race)[2])
        out[s] = own
    return out


def test_seeds_are_drawn_by_distance(spark):
    import random
    rng = random.Random(2)
    rows = [(str(i), [rng.randint(-3000, 3000), rng.randint(0, 9)]) for i in range(400)] + [(f"twin{i}", [50_000, 5]) for i in range(3)]
    df = spark.createDataFrame([(i, *p) for i, p in rows], "id string, z1 bigint, z2 bigint")
    got = K.initial_centres(df.repartition(5), "id", ["z1", "z2"], 4, 6)
    assert got == _seeds_by_hand(rows, 4, 6)
    assert all([50_000, 5] in own for own in got.values())            # far away: drawn as the second or third centre
    assert all(len({tuple(c) for c in own}) == 4 for own in got.values())


def test_equal_points_bring_few_rows_to_the_driver(spark, monkeypatch):
    df = spark.range(200_000).selectExpr("cast(id as string) as id", "7 as z1")
    fetched, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
    assert K.initial_centres(df, "id", ["z1"], 4, 3) == {s: [[7]] for s in range(3)}
    assert [len(x) for x in fetched] == [3, 0]                        # a row a start, then none is left
    assert K.initial_centres(df.where("false"), "id", ["z1"], 4, 2) == {0: [], 1: []}


def test_store_follows_every_parameter(spark, monkeypatch):
    before = C._store(spark, SF0001).path
    assert C._store(spark, SF0001).path == before
    cap = C.FE.build_product_features
    monkeypatch.setattr(C.FE, "build_product_features", lambda clean, revenue_quantile=0.95, min_transactions=10: cap(clean, revenue_quantile, min_transactions))
    assert C._store(spark, SF0001).path != before


def _lloyd_by_pyspark(vectors, k, seed, max_iter, tol):
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features", predictionCol="Cluster").fit(vectors)
    return [[float(v) for v in c] for c in model.clusterCenters()], model.summary.trainingCost


def test_fits_side_by_side_are_those_of_pyspark_and_share_their_passes(spark, monkeypatch):
    r, f = C.rfm(spark, SF0001), ["Recency", "Frequency", "Monetary"]
    vectors, columns = K._scaled_vectors(K._vector_pipeline(r, f), r, f)
    specs, passes, step = [(k, s) for k in (2, 3, 5) for s in (42, 43)], [], K._step
    monkeypatch.setattr(K, "_step", lambda points, zcols, centres, whole=True: passes.append(len(centres)) or step(points, zcols, centres, whole))
    got = K._fit_restarts(vectors, columns, specs, 30, 1e-4, 4)
    for k, s in specs:
        centres, cost = _lloyd_by_pyspark(vectors, k, s, 30, 1e-4)
        assert abs(got[k, s][1] - cost) <= 1e-9 * cost
        assert len(centres) == len(got[k, s][0]) and all(abs(a - b) < 1e-9 for x, y in zip(centres, got[k, s][0]) for a, b in zip(x, y))
    vectors.unpersist()
    assert passes[0] == len(specs) and len(passes) <= 30              # one pass for all fits, not one each


@pytest.mark.parametrize("size", [1000, 2 ** 27])                      # the greater ones are beyond exact doubles
def test_a_pass_is_exact_in_integers(spark, size):
    import random
    rng = random.Random(5)
    rows = [(rng.randint(-size, size), rng.randint(-size, size)) for _ in range(500)] + [(7, 7)] * 3
    centres = {0: [[7, 7], [7, 7], [size, 0]], 3: [list(rows[0])]}     # equal centres: the lower one takes the rows
    got = K._step(spark.createDataFrame(rows, "a bigint, b bigint").repartition(3), ["a", "b"], centres)
    want = {}
    for s, own in centres.items():
        for p in rows:
            d = [sum((x - y) ** 2 for x, y in zip(p, c)) for c in own]
            for key, n, cost, sums in (((s, d.index(min(d))), 1, 0, p), ((s, -1), 0, min(d), (0, 0))):
                a = want.get(key, (0, 0, [0, 0]))
                want[key] = (a[0] + n, a[1] + cost, [x + y for x, y in zip(a[2], sums)])
    assert got == want


def test_drawing_the_starts_sorts_no_rows(spark, monkeypatch):
    """A task keeps the least row of each start, not all rows of all starts."""
    points = spark.createDataFrame([(f"p{i}" if i % 5 else None, i % 7, i % 3) for i in range(60)], "id string, x_milli long, y_milli long")
    plans, kind = [], type(points)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    centres = K.initial_centres(points, "id", ["x_milli", "y_milli"], 4, 3)
    assert len(plans) == 4 and not any(re.search(r"\bSort \[|Generate", p) for p in plans)
    assert sorted(centres) == [0, 1, 2] and all(len({tuple(c) for c in own}) == 4 for own in centres.values())
