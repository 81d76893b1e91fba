import random

import numpy as np
from pyspark.sql import functions as F

from helpers import documents, edge_rows, prose
from tillroll.llm import quality

SF = "/root/testdata/sf0.1"


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)) * 0.3)
    index, value = quality.features(prose(random.Random(1), 50).encode())
    pairs = sum((model.v[index[i]] @ model.v[index[j]]) * value[i] * value[j] for i in range(len(index)) for j in range(i))
    z = 0.3 + model.w[index] @ value + pairs
    assert abs(model.score(index, value) - 1 / (1 + np.exp(-z))) < 1e-5


def test_learns_an_interaction():
    """Neither feature tells alone."""
    rng = np.random.default_rng(2)
    rows, label = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b], np.int32), np.ones(2, np.float32)))
        label.append(float(a == b))
    model = quality.fit(rows, np.array(label), np.ones(len(rows)), epochs=40, decay=0)
    got = np.array([model.score(*r) >= 0.5 for r in rows])
    assert (got == np.array(label)).mean() > 0.95


def test_features_of_edge_rows():
    for _, t in edge_rows():
        index, value = quality.features((t or "").encode())
        assert len(np.unique(index)) == len(index) and index.max() < quality.FEATURES and np.isfinite(value).all()


def test_held_out_accuracy_on_the_supplied_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.classify(docs, quality.train(docs, labels), keep=["doc_id"]).select("row.doc_id", "score", "predicted")
    got = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 500 and len(bad) > 50
    auc = (good.score.values[:, None] > bad.score.values[None, :]).mean()
    assert auc > 0.99 and (good.predicted == 1).mean() > 0.995 and (bad.predicted == 0).mean() > 0.85


def test_edge_rows_and_bounds(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (12, 7, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample=1)
    out = quality.classify(docs, model).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.row.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    constant = quality.train(docs, labels.where("quality = 1"))
    assert len({r.score for r in quality.classify(docs, constant).collect()}) == 1
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs, nothing).collect()} == {0.5}
    assert quality.classify(documents(spark, []), model).count() == 0
    assert quality.train(documents(spark, []), labels) is not None


def test_other_columns_are_no_inputs(spark):
    text = prose(random.Random(3), 40)
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, text, "de", "b")], "doc_id long, text string, lang string, source string")
    model = quality.Machine(0.0, np.random.default_rng(0).normal(size=quality.FEATURES), np.zeros((quality.FEATURES, 2)))
    assert quality.classify(docs, model).select("score").distinct().count() == 1


def test_repeated_ids_neither_grow_the_sample_nor_push_rows_out(spark, monkeypatch):
    rng = random.Random(6)
    once = [(k, prose(rng, 20)) for k in range(1, 41)]
    docs = documents(spark, once + [(1, prose(rng, 20)) for _ in range(300)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 41)], "doc_id long, quality int, toxic int")
    want = {0: 0, 1: 0}
    for r in labels.where(~quality.held_out(F.col("doc_id"))).collect():
        want[r.quality] += 1
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, label, weight: seen.append((len(rows), label, weight)))
    quality.train(docs, labels, sample=25)
    n, label, weight = seen[0]
    assert n == sum(want.values()) and {q: int((label == q).sum()) for q in want} == want
    assert np.allclose(weight, 1)
