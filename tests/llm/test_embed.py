import numpy as np
from pyspark.sql import types as T

from helpers import Union
from tillroll.llm import embed

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("v", "cid", "n", "root", "kept", "block")]])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, *"abcdef") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    own, links = Union(), np.zeros(len(rows), int)
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v) for _, v in rows]
    x = [np.array([np.float32(c) for c in v], np.float64) if k else None for (_, v), k in zip(rows, ok)]
    for i in range(len(rows)):
        own.find(i)
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[[i, j]] += 1
                    own.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = own.find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), int(links[i]), str(least.get(own.find(i)))) for i, (d, _) in enumerate(rows))


def cases():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    rows = [(k, v) for k, v in enumerate(base)]
    for k in range(40):  # near the threshold, both sides
        z = rng.normal(size=24)
        v = base[k % 7]
        z -= z @ v / (v @ v) * v
        cos = 0.95 + (k - 20) / 400
        rows.append((100 + k, cos * v / np.linalg.norm(v) + np.sqrt(1 - cos * cos) * z / np.linalg.norm(z)))
    rows += [(200 + k, base[3] * s) for k, s in enumerate([1, 1, 2, 1e-20, 1e20, -1])]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [None] + [1.0] * 23), (304, [float("nan")] * 24), (305, [float("inf")] + [1.0] * 23),
             (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1.0]), (None, base[5]), (309, base[9]), (309, base[9]), (309, base[10]), (None, [0.0] * 24)]
    return rows


def test_matches_brute_force(spark):
    rows = cases()
    got = embed.near_duplicates(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 8)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(k, centre + rng.normal(size=16) * 0.12) for k in range(90)] + [(500 + k, rng.normal(size=16)) for k in range(30)]
    got = embed.near_duplicates(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for hashes, tables in ((2, 4), embed.plan(10 ** 8, 64)):
        x, y = embed.codes(a, hashes, tables), embed.codes(b, hashes, tables)
        hit = np.zeros(len(a), bool)
        for t in range(tables):
            own = slice(t * embed.PROBES, (t + 1) * embed.PROBES)
            hit |= (x[:, own, None] == y[:, None, own]).any(axis=(1, 2))
        assert hit.mean() >= 0.995, (hashes, tables, hit.mean())


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 32))
    y = embed.rotate(x, 4)
    assert np.allclose(x @ x.T, y @ y.T)


def test_empty_table(spark):
    assert embed.near_duplicates(table(spark, [])).count() == 0
