"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash rotates a vector at random (three rounds of random signs and a Hadamard transform) and takes its largest
coordinate with the sign; a table joins ``hashes`` of them to a code.  Every vector is put in the ``probes`` buckets of a table
that it was nearest to, so that a pair meets if any of its likely codes agree.  Inside a
bucket all pairs are verified with the cosine in double precision.

Equal vectors are one class.  A bucket with more than ``BLOCK`` classes is dealt out as pairs of blocks, so no
task holds more than two blocks; a pair that meets in several buckets counts in the first one only, which both vectors' codes
tell.  A block emits sums and spanning links, never pairs.
"""
from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunFolder, col
from .components import connected_components

BLOCK, PROBES, MISS = 1024, 4, 1e-3


def plan(n: int, dim: int) -> tuple[int, int]:
    """Hashes a table, so that a bucket is expected to hold a bounded number of vectors; and tables, so that a pair at cosine 0.95 is
    missed with a chance of at most ``MISS`` (a table with two hashes and four probes catches 0.91 of them, each further hash 0.8 of that)."""
    hashes = max(2, 1 + math.ceil(math.log(max(1, n / BLOCK)) / math.log(2 * dim)))
    return hashes, max(4, math.ceil(math.log(MISS) / math.log(1 - 0.9 * 0.8 ** (hashes - 2))))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation of rows whose length is a power of two."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        step = 1
        while step < d:
            x = x.reshape(len(x), -1, 2, step)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), d)
            step *= 2
        x = x / math.sqrt(d)
    return x


def codes(x: np.ndarray, hashes: int, tables: int, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(vectors, tables * probes) bucket codes; table t's lie in its own range."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    choice, size, out = min(4, d), (2 * d) ** hashes, []
    combos = list(product(range(choice), repeat=hashes))
    for t in range(tables):
        tops, losses = [], []
        for k in range(hashes):
            y = rotate(x, seed + 1000 * t + k)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :choice]
            best = np.take_along_axis(y, order, 1)
            tops.append(2 * order + (best < 0))
            losses.append((np.abs(best[:, :1]) - np.abs(best)) ** 2)
        loss = np.stack([sum(losses[k][:, c[k]] for k in range(hashes)) for c in combos], axis=1)
        code = np.stack([sum(tops[k][:, c[k]].astype(np.int64) * (2 * d) ** k for k in range(hashes)) for c in combos], axis=1)
        near = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(code, near, 1) + t * size)
    return np.concatenate(out, axis=1)


def _spread(hashes: int, tables: int):
    """A row for each bucket of each class."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors = part.column("v").to_pylist()
                sizes = np.array([len(v) // 8 for v in vectors])
                for dim in np.unique(sizes):
                    own = np.flatnonzero(sizes == dim)
                    x = np.frombuffer(b"".join(vectors[k] for k in own), np.float64).reshape(-1, dim)
                    c = codes(x, hashes, tables)
                    n = c.shape[1]
                    again = np.repeat(own, n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(again), dim, np.int32)), pa.array(c.ravel()), part.column("cid").take(again), part.column("n").take(again),
                         part.column("v").take(again), pa.array([c[k].tobytes() for k in range(len(own)) for _ in range(n)], pa.binary())],
                        ["dim", "code", "cid", "n", "v", "codes"])
    return run


def _verify(threshold: float, probes: int):
    """Sums and spanning links of each block; rows come sorted by (dim, code, bi, bj)."""
    def block(rows):
        code, bi, bj, own = rows["code"][0], rows["bi"][0], rows["bj"][0], rows["block"]
        left, right = (own == bi), (own == bj)
        x = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(own), -1)
        cid, n = rows["cid"], rows["n"]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold - 1e-9)
        i, j = a[i], b[j]
        keep = (cid[i] < cid[j]) if bi == bj else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        # The product above only picks; each cosine is now taken pair by pair in the same order of summation.
        sure = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 65536]], x[j[k:k + 65536]]) >= threshold for k in range(0, len(i), 65536)])
        i, j = i[sure], j[sure]
        if not len(i):
            return None
        c = np.frombuffer(b"".join(rows["codes"]), np.int64).reshape(len(own), -1)
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 65536):
            p, q = c[i[at:at + 65536]], c[j[at:at + 65536]]
            for t in range(0, c.shape[1], probes):
                both = p[:, t:t + probes, None] == q[:, None, t:t + probes]
                first[at:at + 65536] &= ~(both & (p[:, t:t + probes, None] < code)).any(axis=(1, 2))
        add = np.bincount(i[first], n[j[first]], len(own)) + np.bincount(j[first], n[i[first]], len(own))
        label = np.arange(len(own))
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero((add > 0) | (label != np.arange(len(own))))
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(add[some].astype(np.int64)), pa.array(cid[label[some]])], ["cid", "add", "root"])

    def run(batches):
        names = ["dim", "code", "bi", "bj", "block", "cid", "n", "v", "codes"]

        def blocks(rows, last):
            keys = np.stack([rows[k].astype(np.int64) for k in names[:4]], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            done = cuts if last else cuts[:-1]
            for s, e in zip(done, done[1:]):
                if e - s > 1:
                    got = block({k: v[s:e] for k, v in rows.items()})
                    if got is not None:
                        yield got
            rest[0] = {k: v[done[-1]:] for k, v in rows.items()}

        rest = [None]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = {k: (part.column(k).to_numpy(zero_copy_only=False) if k not in ("v", "codes") else np.array(part.column(k).to_pylist(), object)) for k in names}
                held = rest[0]
                if held is not None and len(held["cid"]):
                    rows = {k: np.concatenate([held[k], rows[k]]) for k in names}
                yield from blocks(rows, False)
        if rest[0] is not None and len(rest[0]["cid"]):
            yield from blocks(rest[0], True)
    return run


def near_duplicates(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = 0.95,
                    hashes: int | None = None, tables: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``rows``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of different lengths.  Equal
    vectors link with each other.  Rows without an id take part; they name a component (null) only where no other id does.  Rows with
    one id and different vectors are vectors of their own.  An empty table gives an empty one.
    """
    run = RunFolder(rows.sparkSession, "embed")
    v = F.transform(col(vector), lambda x: x.cast("double"))
    rows = rows.select(col(vec_id).alias("vec_id"), v.alias("v"))
    finite = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(finite)
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Cosine of tiny or huge components: scaled by the largest first, so that no square is lost.
    scaled = classes.withColumn("u", F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y)))))
    classes = run.write(scaled.select(F.monotonically_increasing_id().alias("cid"), "v", "u", "least", "n"), "classes")
    size = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    planned = plan(size[0], size[1] or 2)
    hashes, tables = hashes or planned[0], tables or planned[1]
    packed = classes.select("cid", "n", "u").mapInArrow(_unit, "cid long, n long, v binary")
    buckets = run.write(packed.mapInArrow(_spread(hashes, tables), "dim int, code long, cid long, n long, v binary, codes binary"), "buckets")
    big = run.write(buckets.groupBy("dim", "code").count().where(F.col("count") > BLOCK)
                    .select("dim", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "big")
    own = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = buckets.join(big, ["dim", "code"], "left").withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    dealt = dealt.select("dim", "code", "bi", "bj", "block", "cid", "n", "v", "codes")
    dealt = dealt.repartition("dim", "code", "bi", "bj").sortWithinPartitions("dim", "code", "bi", "bj", "cid")
    links = run.write(dealt.mapInArrow(_verify(threshold, PROBES), "cid long, add long, root long"), "links")
    run.drop("buckets")
    sums = links.groupBy("cid").agg(F.sum("add").alias("add"))
    roots = connected_components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")), run)
    named = classes.select("cid", "v", "least", "n").join(roots.withColumnRenamed("u", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").join(sums, "cid", "left").select("v", "component_id", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"))
    out = good.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~finite).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unit(batches):
    """Vectors of length one as bytes."""
    for batch in batches:
        out = []
        for u in batch.column("u"):
            x = u.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.array(out, pa.binary())], ["cid", "n", "v"])
