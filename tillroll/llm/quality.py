"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), in time
linear in the number of features.  Inputs are the words of the text (hashed, log counts, length one), binned
structure statistics, and the binned length; labels, language, source and ids are never inputs.

The model is fitted on the driver on a bounded sample (``sample`` rows a class, by hash order); weights restore
the classes' shares.  Scoring reads every whole text, task by task, with the model (a few MB, fixed by the parameters) broadcast.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, per_text

#: Hash slots for words; labelled rows of each class to fit on; rank; passes.
SLOTS, SAMPLE, RANK, EPOCHS = 1 << 15, 3000, 8, 12
THRESHOLD = 0.3
_BIN = 12
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Character classes: blank, lower, upper, digit, full stop or comma, other symbol, non-ASCII.
_CLASS = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57
                   else 4 if b in (44, 46) else 6 if b >= 128 else 5 for b in range(256)], np.uint8)
_STATS = 12
FEATURES = SLOTS + _STATS * _BIN
_PIECE = 1 << 20


def _bin(share: float) -> int:
    """Twelve bins, finer towards 0 and 1."""
    return int(min(_BIN - 1, max(0.0, share) ** 0.5 * _BIN))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values of one text."""
    kinds, counts, n, again, lines, distinct_lines, pos = np.zeros(7, np.int64), {}, 0, 0, 0, set(), 0
    while pos < len(text):
        stop = pos + _PIECE
        if stop < len(text):
            cut = text.find(b" ", stop)
            stop = cut + 1 if cut >= 0 else len(text)
        piece = text[pos:stop]
        kinds += np.bincount(_CLASS[np.frombuffer(piece, np.uint8)], minlength=7)
        h = np.fromiter(map(zlib.crc32, piece.translate(_FOLD).split()), np.uint32)
        again += int((h[1:] == h[:-1]).sum())
        n += len(h)
        for slot, c in zip(*(x.tolist() for x in np.unique(h, return_counts=True))):
            counts[slot] = counts.get(slot, 0) + c
        own = piece.split(b"\n")
        lines += len(own)
        distinct_lines.update(map(zlib.crc32, own))
        pos = stop
    blank, lower, upper, digit, point, symbol, other = (kinds / max(1, len(text))).tolist()
    words, letters = max(1, n), max(1e-9, lower + upper)
    top = max(counts.values(), default=0)
    stats = [upper / letters, digit, symbol, point, other, again / words, top / words, len(counts) / words,
             len(text) / words / 20, 1 - len(distinct_lines) / max(1, lines), lines / words, np.log1p(len(text)) / 16]
    slots = np.fromiter((k % SLOTS for k in counts), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    own, where = np.unique(slots, return_inverse=True)
    value = np.bincount(where, value, len(own)) if len(own) else np.zeros(0)
    value /= max(1e-9, float(np.sqrt((value ** 2).sum())))
    dense = np.array([SLOTS + k * _BIN + _bin(s) for k, s in enumerate(stats)])
    return np.concatenate([own, dense]).astype(np.int32), np.concatenate([value, np.full(_STATS, _STATS ** -0.5)]).astype(np.float32)


@dataclass
class Machine:
    """Weights of a factorisation machine."""
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        s = self.v[index] * value[:, None]
        z = self.w0 + float(self.w[index] @ value) + 0.5 * float((s.sum(axis=0) ** 2 - (s ** 2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, rank: int = RANK, epochs: int = EPOCHS,
        rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad over mini-batches of the weighted log loss."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.01, (FEATURES, rank)).astype(np.float32))
    share = float((weight * label).sum() / max(1e-9, weight.sum())) if len(rows) else 0.5
    model.w0 = float(np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99))))
    if len(set(label.tolist())) < 2:
        model.v[:] = 0
        return model
    gw, gv, g0 = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, rank), 1e-6, np.float32), 1e-6
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            some = order[at:at + 64]
            index = np.concatenate([rows[k][0] for k in some])
            value = np.concatenate([rows[k][1] for k in some])
            sizes = [len(rows[k][0]) for k in some]
            cuts, owner = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(some)), sizes)
            vx = model.v[index] * value[:, None]
            s = np.add.reduceat(vx, cuts)
            z = model.w0 + np.add.reduceat(model.w[index] * value, cuts) + 0.5 * (s ** 2 - np.add.reduceat(vx ** 2, cuts)).sum(axis=1)
            d = (weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) / len(some)).astype(np.float32)
            own, where = np.unique(index, return_inverse=True)
            by = np.argsort(where, kind="stable")
            first = np.searchsorted(where[by], np.arange(len(own)))
            dx = d[owner] * value
            dw = np.add.reduceat(dx[by], first) + decay * model.w[own]
            dv = np.add.reduceat((dx[:, None] * (s[owner] - vx))[by], first) + decay * model.v[own]
            gw[own] += dw ** 2
            gv[own] += dv ** 2
            g0 += float(d.sum()) ** 2
            model.w[own] -= rate * dw / np.sqrt(gw[own])
            model.v[own] -= rate * 0.3 * dv / np.sqrt(gv[own])
            model.w0 -= rate * float(d.sum()) / np.sqrt(g0)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used for fitting."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows of each class that aren't held out, the least by hash of the id.

    Of rows with the same id the one with the least text hash counts.  Rows with null ids or labels, and labels other than 0 and 1, are left out; of repeated labels the least counts.  With
    one class only (or none) the model is a constant.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    # One row of each sampled id, the least by hash of its text: at most 2 x sample rows, and map-side, so that no id is hot.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    got = per_text(rows, _extract, "index array<int>, value array<float>", "text", ["doc_id", "quality"])
    got = got.select("row.doc_id", "row.quality", "index", "value").toArrow().to_pydict()
    by_id = sorted(zip(got["doc_id"], got["quality"], got["index"], got["value"]))
    label = np.array([x[1] for x in by_id], np.float64)
    weight = np.array([total[x[1]] / max(1, (label == x[1]).sum()) for x in by_id], np.float64)
    return fit([(np.array(x[2], np.int32), np.array(x[3], np.float32)) for x in by_id], label, weight)


def _extract():
    def work(part):
        got = [features(t) for t in part]
        return {"index": pa.array([x[0] for x in got], pa.list_(pa.int32())), "value": pa.array([x[1] for x in got], pa.list_(pa.float32()))}
    return work


def classify(docs: DataFrame, model: Machine, text: str = "text", threshold: float = THRESHOLD, keep=None) -> DataFrame:
    """``row``, score (0 to 1) and predicted (1 if score >= threshold), for every row.

    Null and empty texts are scored from their structure alone; repeated rows score alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda part: {"score": pa.array([own.score(*features(t)) for t in part], pa.float64())}

    out = per_text(docs, make, "score double", text, keep)
    return out.select("row", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
