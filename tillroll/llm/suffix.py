"""Removal of byte strings that repeat across documents, by prefix-free parsing.

Parse.  A rolling hash over ``KMER`` bytes triggers phrase ends where it is 0 modulo ``PHRASE``.  A phrase is taken with the ``LENGTH`` - 1
bytes after it, so every ``LENGTH``-byte string lies in the one phrase it starts in, and phrases are prefix-free up to the trigger
that ends them.  The dictionary holds the distinct phrases with the least document of each; the parse is the list of phrase
occurrences.  An occurrence in a larger document than its phrase's least is repeated whole: repetitive text costs one dictionary look-up a phrase.

Dictionary suffixes.  What is left, the novel text, is each phrase in its least document.  Its suffixes need an order to depth ``LENGTH`` only, since
strings are equal or not at that depth.  Candidates are found by anchors: of the k-mers in a ``LENGTH``-byte string the one with the least
hash; equal strings have equal anchors at equal places.  Anchors that occur in one document only
are dropped.  For the others the run of strings that share the anchor is the context; equal contexts are one entry again, and only where
contexts of an anchor agree on one side far enough to share a string are the suffixes themselves (cut at ``LENGTH`` bytes) grouped by hash and given their
least document.  No suffix array is built; the grouping stands in for its order.

All grouping is by partial aggregation and joins on bytes (phrases and suffixes: 128-bit hashes), so a passage that a third of
all documents share is one entry, and no task gathers its occurrences.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunFolder, col, column_bytes, slices

LENGTH, KMER, PHRASE = 50, 20, 256
#: Bits of the table that lists shared anchors (8 MB).
TABLE_BITS = 1 << 26
#: Offsets of an anchor in a string that are told apart together before strings are formed.
BLOCK = 8
#: Bytes that are hashed at a time: the arrays stay in a processor's cache.
_STEP = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POS = np.uint64((1 << 21) - 1)
#: Stands for a missing id: after all others.
LAST = (1 << 63) - 1


def rolling_hash(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """Mixed polynomial hash (modulo 2^64) of the k bytes from each position on, by doubling."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, factor = data.astype(np.uint64) + np.uint64(1), 1, _BASE
        out, done = None, 0
        while True:
            if k & width:
                if out is None:
                    out, done = power, width
                else:  # what is done stands behind the new, wider part
                    n = len(data) - done - width + 1
                    shift = _power(done)
                    out, done = power[:n] * shift + out[width:width + n], done + width
            if width * 2 > k:
                break
            n = len(power) - width
            power, factor = power[:n] * factor + power[width:width + n], factor * factor
            width *= 2
        out = out[:len(data) - k + 1]
        out = (out ^ (out >> np.uint64(31))) * _MIX
        return out ^ (out >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def phrase_starts(data: np.ndarray, cuts: np.ndarray, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of strings) of each phrase; ``cuts`` bound the documents in ``data``."""
    found = [cuts[:-1]]
    for at in range(0, len(data), _STEP):
        h = rolling_hash(data[at:at + _STEP + KMER - 1])
        found.append(at + np.flatnonzero((h >> np.uint64(24)) % np.uint64(phrase) == 0))
    start = np.unique(np.concatenate(found))
    start = start[start < cuts[-1]]
    end = cuts[np.searchsorted(cuts, start, "right")]
    # A trigger k-mer that reaches into the next document ends nothing.
    good = (start + KMER <= end) | np.isin(start, cuts)
    start, end = start[good], end[good]
    after = np.minimum(np.r_[start[1:], cuts[-1]], end)
    n = np.minimum(after, end - LENGTH + 1) - start
    return start[n > 0], n[n > 0]


def anchor_runs(data: np.ndarray, valid: np.ndarray):
    """(anchor position, anchor hash, first and last string start) of each run of valid strings with one anchor."""
    width = LENGTH - KMER + 1
    for at in range(0, max(0, len(data) - LENGTH + 1), _STEP):
        piece = data[at:at + _STEP + LENGTH - 1]
        h = rolling_hash(piece)
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        rest = width - span
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        v = np.flatnonzero(valid[at:at + len(least)])
        if not len(v):
            continue
        g = (least[v] & _POS).astype(np.int64)
        first = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (v[1:] != v[:-1] + 1)) + 1]
        last = np.r_[first[1:] - 1, len(v) - 1]
        yield at + g[first], h[g[first]].view(np.int64), at + v[first], at + v[last]


def _arrays(part: pa.RecordBatch):
    """Bytes of the slice's texts, laid end to end, and their bounds."""
    off, data = column_bytes(part.column("text"))
    return data[off[0]:off[-1]], off - off[0]


def _flat(lists: pa.Array, field: str, base: np.ndarray) -> np.ndarray:
    """A field of the structs in a list column, moved to the places of the lists' rows."""
    n = np.diff(lists.offsets.to_numpy())
    values = lists.flatten()
    return values.field(field).to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(base, n)


def _occurrences(batches):
    for batch in batches:
        for part in slices(batch):
            data, cuts = _arrays(part)
            start, n = phrase_starts(data, cuts)
            if not len(start):
                continue
            raw = memoryview(np.ascontiguousarray(data))
            h = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]
            row = np.searchsorted(cuts, start, "right") - 1
            # Empty documents share their bound with the next one; the last of them is the one that holds the phrase.
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.binary()), part.column("doc").take(row), part.column("rk").take(row),
                 pa.array((start - cuts[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "doc", "rk", "at", "n"])


def _novel(part: pa.RecordBatch, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Marks the starts of strings that lie in a document and in no repeated phrase."""
    change = np.zeros(len(data) + 2, np.int32)
    a, b = cuts[:-1], np.maximum(cuts[:-1], cuts[1:] - LENGTH + 1)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    copies = part.column("copies")
    if len(copies.flatten()):
        at, n = _flat(copies, "at", cuts[:-1]), copies.flatten().field("n").to_numpy()
        np.add.at(change, at, -1)
        np.add.at(change, at + n, 1)
    return np.cumsum(change[:-1]) > 0


def _bit_table(shared: DataFrame) -> np.ndarray:
    """``TABLE_BITS`` bits, those of the shared anchors' hashes set: a table of fixed size that lets
    tasks drop most other anchors early.  What it lets through is joined exactly all the same."""
    at = F.pmod(F.col("ah"), F.lit(TABLE_BITS))
    words = shared.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(ah, 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(TABLE_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _listed(table: np.ndarray, ah: np.ndarray) -> np.ndarray:
    at = ah.view(np.uint64) % np.uint64(TABLE_BITS)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _anchors(batches):
    """(ah, doc) of every anchor in novel text."""
    for batch in batches:
        for part in slices(batch):
            data, cuts = _arrays(part)
            for _, ah, first, _ in anchor_runs(data, _novel(part, data, cuts)):
                row = np.searchsorted(cuts, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ah), part.column("doc").take(row)], ["ah", "doc"])


def _contexts(table):
    """The context of every run whose anchor the bit table lists: ah, ctx, rel (place of the anchor in it), and where it is."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, cuts = _arrays(part)
                raw = memoryview(np.ascontiguousarray(data))
                for pos, ah, first, last in anchor_runs(data, _novel(part, data, cuts)):
                    own = _listed(table.value, ah)
                    pos, ah, first, last = pos[own], ah[own], first[own], last[own]
                    if not len(pos):
                        continue
                    row = np.searchsorted(cuts, first, "right") - 1
                    ctx = [bytes(raw[a:b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ah), pa.array(ctx, pa.binary()), pa.array((pos - first).astype(np.int32)), part.column("doc").take(row), part.column("rk").take(row),
                         pa.array((first - cuts[row]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["ah", "ctx", "rel", "doc", "rk", "at", "n"])
    return run


def merged(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs (start, end) that strings starting in [at, at + n) cover, merged."""
    if not len(at):
        return at, at
    order = np.argsort(at, kind="stable")
    a, b = at[order], np.maximum.accumulate((at + n + LENGTH - 1)[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[new[1:], True]]


def _cut(keep_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, cuts = _arrays(part)
                whole = data.tobytes()
                lists = [(part.column(c).offsets.to_numpy(), part.column(c).flatten().field("at").to_numpy(), part.column(c).flatten().field("n").to_numpy()) for c in ("copies", "more")]
                removed, spans, digest, kept = [], [], [], []
                for k in range(part.num_rows):
                    lo, hi = int(cuts[k]), int(cuts[k + 1])
                    own = [(at[o[k] - o[0]:o[k + 1] - o[0]], n[o[k] - o[0]:o[k + 1] - o[0]]) for o, at, n in lists]
                    a, b = merged(np.concatenate([x[0] for x in own]).astype(np.int64), np.concatenate([x[1] for x in own]).astype(np.int64))
                    rest, pos = [], lo
                    for s, e in zip((a + lo).tolist(), (b + lo).tolist()):
                        rest.append(whole[pos:s])
                        pos = e
                    rest = b"".join([*rest, whole[pos:hi]])
                    removed.append(int((b - a).sum()))
                    spans.append(len(a))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if keep_text else None)
                columns = [part.column("doc_id"), pa.array(np.diff(cuts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless ``keep_text``): a row for each row.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id, judged on the input.  Null
    and empty texts, and texts shorter than ``LENGTH``, lose nothing.  Rows without an id come after all others and do not see
    each other; nor do rows with one id.  An empty table gives an empty one.
    """
    run = RunFolder(docs.sparkSession, "suffix")
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("rk", F.xxhash64("doc_id", "text"))
    ranges, key = "array<struct<at:int,n:int>>", ["ah", "ctx", "rel"]
    none = F.expr(f"cast(array() as {ranges})")

    # Parse and dictionary: occurrences of a phrase in documents after its least one are repeated whole.
    parse = run.write(rows.select("doc", "rk", "text").mapInArrow(_occurrences, "h binary, doc long, rk long, at int, n int"), "parse")
    dictionary = run.write(parse.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least").select("h", "least"), "dictionary")
    copies = parse.join(dictionary, "h").where("doc > least").groupBy("doc", "rk").agg(F.collect_set(F.struct("at", "n")).alias("copies"))  # at most a document's phrases
    novel = run.write(rows.join(copies, ["doc", "rk"], "left").select("doc_id", "doc", "rk", "text", F.coalesce("copies", none).alias("copies")), "novel")
    run.drop("parse")
    run.drop("dictionary")

    # Anchors of novel text in several documents, and the contexts around them.
    shared = novel.select("doc", "text", "copies").mapInArrow(_anchors, "ah long, doc long").groupBy("ah").agg(F.min("doc").alias("a"), F.max("doc").alias("z"))
    shared = run.write(shared.where("a < z").select("ah"), "shared")
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(shared))
    contexts = novel.select("doc", "rk", "text", "copies").mapInArrow(_contexts(table), "ah long, ctx binary, rel int, doc long, rk long, at int, n int")
    contexts = run.write(contexts.join(shared, "ah", "left_semi"), "contexts")
    run.drop("shared")
    entries = contexts.groupBy(*key).agg(F.min("doc").alias("least"))
    entries = run.write(entries.withColumn("eid", F.monotonically_increasing_id()), "entries")
    placed = run.write(contexts.join(entries, key).select("eid", "least", "doc", "rk", "at", "n"), "placed")
    run.drop("contexts")

    # Suffixes of contexts, cut at LENGTH bytes, with their least document.  A suffix has its anchor at some offset; for a block of
    # offsets, contexts that share one agree on the bytes that all suffixes of the block have.
    spare, last = LENGTH - KMER, F.length("ctx") - LENGTH
    blocks = []
    for low in range(0, spare + 1, BLOCK):
        high = min(spare, low + BLOCK - 1)
        first, stop = F.greatest(F.lit(low), F.col("rel") - last), F.least(F.lit(high), F.col("rel"))
        same = F.xxhash64("ah", F.lit(low), F.expr(f"substring(ctx, rel - {low} + 1, {low})"), F.expr(f"substring(ctx, rel + {KMER} + 1, {spare - high})"))
        blocks.append(F.struct(first.alias("first"), stop.alias("stop"), F.when(first <= stop, same).alias("same")))
    sides = entries.select("eid", "least", F.explode(F.filter(F.array(*blocks), lambda x: x["same"].isNotNull())).alias("b")).select("eid", "least", "b.*")
    agreed = run.write(sides.groupBy("same").agg(F.min("least").alias("a"), F.max("least").alias("z")).where("a < z").select("same"), "agreed")
    close = run.write(sides.join(agreed, "same", "left_semi").select("eid", "first", "stop"), "close")
    suffixes = entries.join(close, "eid").select("eid", "least", "ctx", "rel", F.explode(F.sequence("first", "stop")).alias("offset"))
    suffixes = suffixes.withColumn("j", F.col("rel") - F.col("offset")).withColumn("suffix", F.expr(f"substring(ctx, j + 1, {LENGTH})"))
    order = [F.xxhash64("suffix").alias("h1"), F.xxhash64(F.lit(1), F.col("suffix")).alias("h2")]  # 128 bits stand for the 50 bytes
    suffixes = run.write(suffixes.select("eid", "least", "j", *order), "suffixes")
    run.drop("close")
    run.drop("entries")
    repeated = suffixes.groupBy("h1", "h2").agg(F.min("least").alias("first"), F.max("least").alias("most")).where("first < most").drop("most")
    found = run.write(suffixes.join(run.write(repeated, "repeated"), ["h1", "h2"]).where("first < least").select("eid", "j"), "found")
    run.drop("suffixes")
    run.drop("repeated")

    late = placed.where("doc > least").select("doc", "rk", "at", "n")
    early = placed.where("doc = least").select("eid", "doc", "rk", "at").join(found, "eid").select("doc", "rk", (F.col("at") + F.col("j")).alias("at"), F.lit(1).alias("n"))
    more = late.unionByName(early).groupBy("doc", "rk").agg(F.collect_set(F.struct("at", "n")).alias("more"))  # at most a document's bytes
    out = novel.join(run.write(more, "more"), ["doc", "rk"], "left").select("doc_id", "text", "copies", F.coalesce("more", none).alias("more"))
    kind = docs.select(col(doc_id)).schema[0].dataType.simpleString()
    return out.mapInArrow(_cut(keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
