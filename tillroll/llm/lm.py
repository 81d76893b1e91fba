"""Stupid-backoff scores of documents, computed relationally.

The model counts byte n-grams of orders 1 to ``ORDER``.  A gram is a long: its order in the high byte, its bytes
below, so that the context (all but the last byte) and the suffix (all but the first) are arithmetic on the key.

    S(gram) = c(gram) / c(context)   if c(gram) >= ``MIN_COUNT``
            = BACKOFF * S(suffix)    otherwise;         S(one byte) = c / N

Documents are dealt to parts of about ``PART_BYTES`` by their ids.  A part lists its distinct n-grams with their numbers; the count table, hash
partitioned by gram, is their sum; scores are joined to the parts' lists, and come back to the parts, where the grams of each
document are looked up and summed.  A frequent gram is one row a part, so no key is hot, and rows grow with the
number of parts, not with the occurrences.

``word_score`` does the same with words (orders 1 and 2), in Spark's own operators: each text is split once and written as its words'
64-bit hashes; counts are aggregated on the map side, joined
to the exploded grams of the documents, and summed by document.  The grams are dealt by hash to ``WORD_BLOCKS`` blocks, one after the other, so that
only one block's shuffle files are on disk.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunFolder, col, column_bytes

ORDER, BACKOFF, MIN_COUNT, PART_BYTES = 5, 0.4, 2, 16 << 20
_STEP = 1 << 21
WORD_BLOCKS = 4


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Keys of the grams of ``order`` bytes from each position on."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.full(n, order << 56, np.int64)
    for k in range(order):
        key |= data[k:k + n].astype(np.int64) << (8 * (order - 1 - k))
    return key


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, where = np.unique(keys, return_inverse=True)
    return own, np.bincount(where, n, len(own)).astype(np.int64)


def _blocks(table: pa.Table, order: int):
    """(keys of the grams of ``order`` bytes, their documents), some MB of text at a time."""
    off, data = column_bytes(table.column("text").combine_chunks())
    data, off = data[off[0]:off[-1]], off - off[0]
    end = off[1:]
    for at in range(0, len(data), _STEP):
        keys = grams(data[at:at + _STEP + order - 1], order)
        pos = np.arange(at, at + len(keys))
        doc = np.searchsorted(off, pos, "right") - 1
        whole = pos + order <= end[doc]
        yield keys[whole], doc[whole]


def _edges(table: pa.Table, order: int, at_end: bool):
    """(order, keys, documents) of the grams shorter than ``order`` that end (or start) a document."""
    off, data = column_bytes(table.column("text").combine_chunks())
    for o in range(1, order):
        doc = np.flatnonzero(np.diff(off) >= o)
        first = off[doc + 1] - o if at_end else off[doc]
        key = np.full(len(doc), o << 56, np.int64)
        for k in range(o):
            key |= data[first + k].astype(np.int64) << (8 * (o - 1 - k))
        yield o, key, doc


def _counts(order: int):
    """part, gram, n of a part's documents.  Shorter grams are the contexts of longer ones, and those that end a document."""
    def work(key, table):
        found = [np.unique(keys, return_counts=True) for keys, _ in _blocks(table, order)]
        empty = np.zeros(0, np.int64)
        g, n = _merged(np.concatenate([empty, *(x[0] for x in found)]), np.concatenate([empty, *(x[1] for x in found)]))
        out, ends = [(g, n)], {o: keys for o, keys, _ in _edges(table, order, True)}
        for o in range(order - 1, 0, -1):
            context = ((g & ((1 << 56) - 1)) >> 8) | (o << 56)
            g, n = _merged(np.concatenate([context, ends[o]]), np.concatenate([n, np.ones(len(ends[o]), np.int64)]))
            out.append((g, n))
        g, n = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return pa.table({"part": pa.array(np.full(len(g), key[0].as_py(), np.int64)), "gram": pa.array(g), "n": pa.array(n)})
    return work


def _sums(order: int):
    """doc_id, n_bytes and sum_log of a part's documents from the part's list of scores."""
    def work(key, table, scores):
        by = np.argsort(known := scores.column("gram").to_numpy())
        known, log_s = known[by], scores.column("log_s").to_numpy()[by]
        total = np.zeros(table.num_rows)
        for keys, doc in _blocks(table, order):
            total += np.bincount(doc, log_s[np.searchsorted(known, keys)], table.num_rows)
        for _, keys, doc in _edges(table, order, False):
            total += np.bincount(doc, log_s[np.searchsorted(known, keys)], table.num_rows)
        off, _ = column_bytes(table.column("text").combine_chunks())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "sum_log": pa.array(total)})
    return work


def backoff_scores(counts: DataFrame, run: RunFolder, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(gram, log_s) of every counted gram, from the table (gram, n)."""
    own = lambda o: counts.where(F.shiftright("gram", 56) == o)
    low = F.lit((1 << 56) - 1).cast("long")
    size = own(1).agg(F.sum("n")).first()[0] or 1
    levels = [run.write(own(1).select("gram", F.log(F.col("n") / F.lit(float(size))).alias("log_s")), "s1")]
    for o in range(2, order + 1):
        body = F.col("gram").bitwiseAND(low)
        rows = own(o).select("gram", "n", F.shiftright(body, 8).bitwiseOR(F.lit((o - 1) << 56).cast("long")).alias("context"),
                             body.bitwiseAND(F.lit((1 << 8 * (o - 1)) - 1).cast("long")).bitwiseOR(F.lit((o - 1) << 56).cast("long")).alias("suffix"))
        rows = rows.join(own(o - 1).select(F.col("gram").alias("context"), F.col("n").alias("n_context")), "context")
        rows = rows.join(levels[-1].select(F.col("gram").alias("suffix"), F.col("log_s").alias("log_suffix")), "suffix")
        seen = F.log(F.col("n") / F.col("n_context").cast("double"))
        levels.append(run.write(rows.select("gram", F.when(F.col("n") >= min_count, seen).otherwise(F.lit(math.log(backoff)) + F.col("log_suffix")).alias("log_s")), f"s{o}"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, sum_log (natural logarithm of the scores of all bytes), for every row.

    The model is counted over all documents.  Null and empty texts have no bytes and sum 0; repeated rows are counted and scored each; an empty
    table gives an empty one.
    """
    if not 2 <= order <= 6:
        raise ValueError("order is from 2 to 6")
    run = RunFolder(docs.sparkSession, "lm")
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    # Dealt by row, so that neither copies nor repeated ids meet in one part.
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(parts)).cast("long"))
    dealt = run.write(dealt, "dealt")
    listed = run.write(dealt.groupBy("part").applyInArrow(_counts(order), "part long, gram long, n long"), "listed")
    counts = run.write(listed.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    scores = backoff_scores(counts, run, order)
    back = run.write(listed.select("part", "gram").join(scores, "gram"), "back")
    run.drop("listed")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_sums(order), f"doc_id {kind}, n_bytes long, sum_log double")


def _word_grams(rows: DataFrame) -> DataFrame:
    """rid, a, b, gram of each word: the hashes of the word before (null for a text's first), the word and both."""
    rows = rows.select("rid", "h", F.posexplode("h").alias("i", "b"))
    rows = rows.select("rid", F.get("h", F.col("i") - 1).alias("a"), "b")
    return rows.withColumn("gram", F.xxhash64("a", "b"))


def word_score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", backoff: float = BACKOFF, min_count: int = MIN_COUNT,
               blocks: int = WORD_BLOCKS) -> DataFrame:
    """doc_id, n_words, sum_log (natural logarithm of the scores of all words), for every row.

    Words are what stands between ASCII blanks, as written.  The model is counted over all documents; null and empty texts have no words
    and sum 0; repeated rows are counted and scored each; an empty table gives an empty one.
    """
    run = RunFolder(docs.sparkSession, "lm-words")
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.expr(f"transform({words}, w -> xxhash64(w))").alias("h"))
    rows = run.write(rows, "rows")  # the texts are split once; from here on words are their hashes
    grams = _word_grams(rows)
    words = run.write(grams.groupBy(F.col("b").alias("word")).agg(F.count("*").alias("c")), "words")
    size = float(words.agg(F.sum("c")).first()[0] or 1)
    seen = (F.col("n") >= min_count) & F.col("a").isNotNull()
    found = F.when(seen, F.log(F.col("n") / F.col("c").cast("double"))).otherwise(
        F.when(F.col("a").isNull(), 0.0).otherwise(math.log(backoff)) + F.log(F.col("c") / F.lit(size)))
    sums = None
    for k in range(blocks):
        own = grams.where(F.pmod("gram", F.lit(blocks)) == k)
        counts = own.groupBy("gram").agg(F.count("*").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"))
        # A counted gram needs its context's count, any other its last word's.
        counts = counts.withColumn("word", F.when(seen, F.col("a")).otherwise(F.col("b")))
        scores = run.write(counts.join(words, "word").select("gram", found.alias("log_s")), f"scores{k}")
        part = own.select("rid", "gram").join(scores, "gram").groupBy("rid").agg(F.count("*").alias("n_words"), F.sum("log_s").alias("sum_log"))
        part = run.write(part, f"sums{k}")
        run.drop(f"scores{k}")
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("rid").agg(F.sum("n_words").alias("n_words"), F.sum("sum_log").alias("sum_log"))
    return rows.select("rid", "doc_id").join(sums, "rid", "left").select(
        "doc_id", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("sum_log", F.lit(0.0)).alias("sum_log"))
