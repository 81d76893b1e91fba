"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of consecutive words.  For patterns of m words, a shift
table over blocks of two words says how far the search may jump: a block that ends
q words into some pattern allows m - q, an unknown block m - 1.  At shift 0 the
block is the suffix of some patterns; they are looked up by that suffix and compared word by word.
Items of fewer words than a window are patterns of their own length, searched in a pass for each length.

Documents are scanned where they lie: no shuffle, and a hot passage costs
only its own occurrences.  The pattern table goes to all tasks, so its size is
checked: patterns are cut in shards of at most ``shard_bytes`` of benchmark text, and each shard
is one more narrow pass whose hits are added to those of the passes before.
"""
from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, slices, texts

WINDOW = 10
#: Benchmark text that one broadcast pattern table may come from.
SHARD_BYTES = 8 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


class WuManber:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set]] = defaultdict(dict)

    def add(self, pattern: tuple, item: str) -> None:
        for q in range(self.block, self.m + 1):
            part = pattern[q - self.block:q]
            self.shift[part] = min(self.shift.get(part, self.default), self.m - q)
        self.bucket[pattern[-self.block:]].setdefault(pattern, set()).add(item)

    def search(self, doc: list[bytes]):
        """(first word, items) of every occurrence."""
        n, m, shift, default = len(doc), self.m, self.shift.get, self.default
        i = m
        if self.block == 2:
            while i <= n:
                step = shift((doc[i - 2], doc[i - 1]), default)
                if step:
                    i += step
                    continue
                items = self.bucket[doc[i - 2], doc[i - 1]].get(tuple(doc[i - m:i]))
                if items:
                    yield i - m, items
                i += 1
        else:
            for i, word in enumerate(doc):
                if (word,) in self.bucket:
                    yield i, self.bucket[word,][word,]


def build(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each pattern length."""
    by: dict[int, WuManber] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        if m:
            own = by.setdefault(m, WuManber(m))
            for i in range(len(w) - m + 1):
                own.add(tuple(w[i:i + m]), item)
    return list(by.values())


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted and merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_STATE = "row {row}, text string, n_words long, hits array<struct<start:long,stop:long>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _pass(shard):
    """Adds the hits of one shard's patterns to the columns n_words, hits and items."""
    def run(batches):
        searchers = shard.value
        for batch in batches:
            for part in slices(batch):
                n_words, hits, items = [], part.column("hits").to_pylist(), part.column("items").to_pylist()
                for k, text in enumerate(texts(part.column("text"))):
                    doc = words(text)
                    n_words.append(len(doc))
                    spans, found = [], set()
                    for s in searchers:
                        for at, names in s.search(doc):
                            spans.append((at, at + s.m))
                            found |= names
                    if spans:
                        spans += [(x["start"], x["stop"]) for x in hits[k]]
                        hits[k] = [{"start": a, "stop": b} for a, b in _covered(spans)]
                        items[k] = sorted(found | set(items[k]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))],
                    ["row", "text", "n_words", "hits", "items"])
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep=None) -> DataFrame:
    """``row``, n_words, n_hit, hits (merged word spans, end exclusive), items (sorted ids as strings).

    A word inside any occurrence of a benchmark window counts once in n_hit.  Null and
    empty texts have no words and no hits; a benchmark item without words has no window;
    a null item id is named "null"; repeated items and rows each count as given; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    source = benchmark.select(F.coalesce(col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(col(item_text).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    source = source.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    state = packed(docs, text, keep)
    schema = _STATE.format(row=state.schema["row"].dataType.simpleString())
    state = state.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,stop:long>>)").alias("hits"),
                         F.expr("cast(array() as array<string>)").alias("items"))
    for k in range(shards):
        items = [(r.id, r.text.encode()) for r in source.where(F.col("shard") == k).select("id", "text").toLocalIterator()]
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(build(items, window))), schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return state.select("row", "n_words", n_hit.alias("n_hit"), "hits", "items")


def items_digest(items) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)
