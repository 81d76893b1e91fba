"""Silhouettes against a plain version over all pairs."""
import math
import random

from tillroll.operators.silhouette import silhouettes


def brute(rows):
    sizes = {c: sum(x[1] == c for x in rows) for _, c, *_ in rows}
    out = []
    for power in (1, 2):
        total = 0.0
        for i, c, *p in rows:
            mean = {d: sum(math.dist(p, q) ** power for _, e, *q in rows if e == d) / max(1, sizes[d] - (d == c)) for d in sizes}
            a, b = mean[c], min(v for d, v in mean.items() if d != c)
            total += 0.0 if sizes[c] == 1 or max(a, b) == 0 else (b - a) / max(a, b)
        out.append(total / len(rows))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, Cluster int, x double, y double")


def test_matches_all_pairs_with_ties_and_lone_rows(spark):
    rng = random.Random(1)
    rows = [(f"r{k}", k % 3, rng.gauss(k % 3 * 2, 1), rng.gauss(0, 1)) for k in range(700)] + [("lone", 9, 50.0, 50.0), ("twin", 1, 2.0, 0.0), ("twin", 1, 2.0, 0.0)]
    got = silhouettes(frame(spark, rows).repartition(5), "id", ["x", "y"]).first()
    want = brute(rows)
    assert (got.n_rows, got.n_sampled) == (703, 703)
    assert abs(got.euclidean - want[0]) < 1e-9 and abs(got.squared - want[1]) < 1e-9


def test_a_sample_is_bounded_and_does_not_depend_on_order(spark):
    rng = random.Random(2)
    rows = [(f"r{k}", k % 2, rng.gauss(k % 2 * 4, 1), 0.0) for k in range(3000)]
    got = [silhouettes(frame(spark, rows[s:] + rows[:s]).repartition(s + 1), "id", ["x", "y"], sample=500).first() for s in (0, 3)]
    assert got[0].n_sampled == 500 and got[0].n_rows == 3000 and abs(got[0].euclidean - got[1].euclidean) < 1e-12
    assert abs(got[0].euclidean - silhouettes(frame(spark, rows), "id", ["x", "y"]).first().euclidean) < 0.05


def test_few_clusters_nulls_and_empty(spark):
    one = silhouettes(frame(spark, [("a", 1, 0.0, 0.0), ("b", 1, 1.0, 0.0), (None, 2, 0.0, 0.0), ("c", None, 0.0, 0.0)]), "id", ["x", "y"]).first()
    assert (one.n_rows, one.n_sampled, one.euclidean, one.squared) == (2, 2, None, None)
    assert silhouettes(frame(spark, []), "id", ["x", "y"]).first().n_sampled == 0
    same = silhouettes(frame(spark, [(str(k), k % 2, 1.0, 1.0) for k in range(6)]), "id", ["x", "y"]).first()
    assert same.euclidean == 0.0
