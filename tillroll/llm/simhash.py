"""SimHash near-duplicates with covering locality-sensitive hashing.

A covering family for radius r has 2^(r+1) - 1 bit masks.  Bit i gets a non-zero
vector m(i) of r+1 bits; the mask of a non-zero vector v keeps the bits with
<m(i), v> = 1 (mod 2).  At most r differing bits give at most r linear
conditions on v, so some v is orthogonal to all of them, and that mask hides
every difference: each pair within the radius collides in some table, surely.

A bucket with more than ``BUCKET`` fingerprints is dealt out anew by the bits its mask
hides, cut in r+1 blocks: of at most r differences one block has none.  This
repeats until buckets are small, which distinct fingerprints guarantee, so no
bucket is capped and none is compared whole when it is large.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunFolder, col, per_text
from .components import connected_components

#: Fingerprints that are compared directly; larger buckets are dealt out anew.
BUCKET = 1024
_SEED = 42
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_PIECE = 1 << 20


def _word_pieces(text: bytes):
    """Lists of words; cut only at blanks, so that a very long text needs little memory."""
    pos = 0
    while pos < len(text):
        stop = pos + _PIECE
        if stop < len(text):
            cut = text.rfind(b" ", pos, stop)
            if cut <= pos:
                cut = text.find(b" ", stop)
            stop = cut + 1 if cut >= 0 else len(text)
        yield text[pos:stop].split()
        pos = stop


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles (no words: 0)."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for words in _word_pieces(text.translate(_FOLD)):
        words = carry + words
        if len(words) >= shingle:
            parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
            n = len(words) - shingle + 1
            h = np.fromiter((xxhash.xxh64_intdigest(p, _SEED) for p in parts), np.uint64, n)
            for at in range(0, n, 4096):
                bits = np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int32)
            total += n
        carry = words[len(words) - shingle + 1:] if len(words) >= shingle else words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), _SEED) if carry else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep=None) -> DataFrame:
    """``row`` and ``fp`` (the 64 bits as a signed long); null and empty texts have 0."""
    def make():
        return lambda part: {"fp": pa.array(np.array([fingerprint(t, shingle) for t in part], np.uint64).view(np.int64), pa.int64())}

    return per_text(docs, make, "fp long", text, keep)


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks of 64 bits; vectors are dealt to the bits in turn, so masks are of like size."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _submasks(mask: int, radius: int) -> list[int]:
    """The mask with one of radius+1 blocks of the hidden bits added."""
    hidden = [i for i in range(64) if not mask >> i & 1]
    blocks = [hidden[b::radius + 1] for b in range(radius + 1)]
    return [mask | sum(1 << i for i in block) for block in blocks if block]


def _deal(radius: int):
    """Rows of large buckets again, once for each finer mask."""
    def run(batches):
        for batch in batches:
            mask, fp = (batch.column(c).to_numpy() for c in ("mask", "fp"))
            for m in np.unique(mask):
                own = fp[mask == m]
                for sub in _submasks(int(m) & (1 << 64) - 1, radius):
                    s = np.int64(_signed(sub))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), s)), pa.array(own & s), pa.array(own)], ["mask", "key", "fp"])
    return run


def _bucket_links(own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint it reaches in this bucket), for those that reach one."""
    near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
    if not np.triu(near, 1).any():
        return own[:0], own[:0]
    label = np.arange(len(own))
    while True:
        new = np.where(near, label[None, :], len(own)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(own))
    return own[moved], own[label[moved]]


def _links(radius: int):
    """Spanning links of each bucket; rows come sorted by bucket and a bucket may go on in the next batch."""
    def work(mask, key, fp):
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        close = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        us, vs = [a[close]], [b[close]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            u, v = _bucket_links(fp[s:s + n], radius)
            us.append(u)
            vs.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rest = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("mask", "key", "fp"))]
            last = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1]))
            if len(last):
                yield work(*[r[:last[-1] + 1] for r in rest])
                rest = [r[last[-1] + 1:] for r in rest]
        if len(rest[0]):
            yield work(*rest)
    return run


def covering_links(nodes: DataFrame, run: RunFolder, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(u, v) links that connect the distinct fingerprints ``fp`` exactly as all pairs within ``radius`` would."""
    schema = "mask long, key long, fp long"
    masks = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius)]))
    rows = nodes.select(masks.alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found, level = [], 0
    while True:
        big = run.write(rows.groupBy("mask", "key").count().where(F.col("count") > bucket).select("mask", "key"), f"big{level}")
        more = not big.isEmpty()
        small = rows.join(big, ["mask", "key"], "left_anti") if more else rows
        small = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found.append(run.write(small.mapInArrow(_links(radius), "u long, v long"), f"links{level}"))
        if not more:
            break
        hot = rows.join(big, ["mask", "key"], "left_semi").mapInArrow(_deal(radius), schema)
        rows, level = run.write(hot.distinct(), f"dealt{level}"), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
                    radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id, root: one row for each row of ``docs``; ``root`` is the group's least fingerprint.

    Texts whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the least doc_id reachable, itself included.  Null and empty
    texts have fingerprint 0 and are linked like any other; repeated rows are
    equal and so linked; a null doc_id takes part in links, and names a component
    only where no other id does.  An empty table gives an empty one.
    """
    run = RunFolder(docs.sparkSession, "simhash")
    fps = fingerprints(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), "text", shingle, ["doc_id"])
    fps = run.write(fps.select("row.doc_id", "fp"), "fps")
    nodes = run.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(covering_links(nodes, run, radius, bucket), run)
    rooted = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root"), "fp").select("doc_id", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each group, with the columns of ``docs``: the row with the least doc_id.

    Among rows without an id, and among rows with that id, the one with the least hash of
    all its columns stays, whatever the input's order; rows that are equal in all columns are one. A row
    without an id stays only where no row of its group has one.
    """
    found = near_duplicates(docs, text, doc_id, shingle, radius)
    best = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "fp")).alias("best")
    keep = found.groupBy("root").agg(best).select(F.col("best.doc_id").alias("keep_id"), F.col("best.fp").alias("keep_fp"))
    rows = fingerprints(docs, text, shingle).select("row", "fp", F.col("row")[doc_id].alias("id"))
    rows = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")), "left_semi")
    rows = rows.withColumn("tie", F.to_json("row")).withColumn("tie", F.struct(F.xxhash64("tie").alias("a"), F.xxhash64(F.lit(1), "tie").alias("b")))
    return rows.groupBy("id", "fp").agg(F.min_by("row", "tie").alias("row")).select("row.*")
