"""Token ids in binary files: byte or bit planes of fixed-size blocks, each compressed with zstandard, and a chunk index.

Documents are put in order of their ids by a range partitioning, so each partition is a
shard of the ordered corpus.  A shard is a run of chunks; a chunk holds whole documents, its ids
cut in blocks of ``BLOCK``; a block's ids are transposed so that the like bytes (or bits) of all ids lie together,
and each plane is compressed alone.  Files are written by Spark's Parquet writer, one binary value a
chunk, so they commit atomically and any store that Spark writes to will do.

Chunk layout, little-endian: magic "TBP1", u8 planes a block (4 or 32), 3 zero bytes, u32 block size, u64 ids;
then for every block its planes' compressed sizes (u32 each) and the planes.
"""
from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import BLANK, LOWER, NUMBER, ChunkEncoder
from .common import RunFolder, col, slices, texts

BLOCK, CHUNK_IDS, LEVEL = 16384, 1 << 17, 3
_WORD = re.compile(f"[^{BLANK}]+")
#: The vocabulary's split of lower-cased Latin-1 texts: contractions, letters, single numbers, other characters but blanks.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[{NUMBER}]|[^{BLANK}{LOWER}{NUMBER}]+")
_HEAD = struct.Struct("<4sB3xIQ")


def pack(ids: np.ndarray, planes: str = "byte", block: int = BLOCK, level: int = LEVEL) -> bytes:
    """One chunk from unsigned 32-bit ids."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    n_planes = {"byte": 4, "bit": 32}[planes]
    out = [_HEAD.pack(b"TBP1", n_planes, block, len(ids))]
    for at in range(0, len(ids), block):
        rows = ids[at:at + block].astype("<u4").view(np.uint8).reshape(-1, 4)
        if planes == "bit":
            rows = np.unpackbits(rows, axis=1, bitorder="little")
            parts = [squeeze(np.packbits(rows[:, k], bitorder="little").tobytes()) for k in range(32)]
        else:
            parts = [squeeze(np.ascontiguousarray(rows[:, k]).tobytes()) for k in range(4)]
        out.append(struct.pack(f"<{n_planes}I", *map(len, parts)))
        out += parts
    return b"".join(out)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; damaged data raises."""
    expand = zstandard.ZstdDecompressor().decompress
    magic, n_planes, block, n = _HEAD.unpack_from(chunk)
    if magic != b"TBP1" or n_planes not in (4, 32):
        raise ValueError("not a token chunk")
    out, pos = np.empty(n, "<u4"), _HEAD.size
    for at in range(0, n, block):
        size = min(block, n - at)
        lengths = struct.unpack_from(f"<{n_planes}I", chunk, pos)
        pos += 4 * n_planes
        parts = []
        for length in lengths:
            parts.append(np.frombuffer(expand(chunk[pos:pos + length]), np.uint8))
            pos += length
        if n_planes == 32:
            rows = np.packbits(np.stack([np.unpackbits(p, count=size, bitorder="little") for p in parts], axis=1), axis=1, bitorder="little")
        else:
            rows = np.stack(parts, axis=1)
        out[at:at + size] = np.ascontiguousarray(rows).view("<u4").ravel()
    return out


#: Distinct pieces that a worker remembers, some 100 MB.
REMEMBER = 1 << 19


class Words:
    """Encoder of a word vocabulary (lower case, blanks dropped), with the ids of the library's plain call.

    A text that holds the string of an added token, whatever its case, goes whole through the library, which makes it one id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.plain.get_added_tokens_decoder().values()]
        self.first = {c for t in self.added for c in (t[:1], t[:1].upper())}
        by_chunk = Tokenizer.from_file(path)
        by_chunk.encode_special_tokens = True
        self.chunks = ChunkEncoder(by_chunk, _WORD, _SPLIT, fold=True, limit=REMEMBER)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        special = {k for k, x in enumerate(texts) if any(c in x for c in self.first) and any(t in x.lower() for t in self.added)}
        out = self.chunks.encode_all([b"" if k in special else x for k, x in enumerate(texts)])
        for k in special:
            out[k] = np.array(self.plain.encode(texts[k].decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One encoder a Python worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def write_tokens(docs: DataFrame, folder: RunFolder, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
                 planes: str = "byte", chunk_ids: int = CHUNK_IDS, name: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Write all documents' ids in ascending order of doc_id; returns the chunk files and their index.

    Chunk files: shard, chunk, n_ids, entries (doc_id, n of each document, in order), payload.  Index: shard, chunk, n_ids,
    start (ids of all chunks before).  Null ids come first; rows with the same id are ordered by their text; a null or empty text holds the end id only.
    """
    tied = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    tied = tied.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange("doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie").select("doc_id", "text")
    kind = ordered.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches):
        own, here, chunk, ids, held, entries = words(tokenizer), TaskContext.get().partitionId(), 0, [], 0, []

        def flush():
            data = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([here], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(data)], pa.int64()),
                 pa.array([[{"doc_id": d, "n": n} for d, n in entries]], pa.list_(pa.struct([("doc_id", id_type), ("n", pa.int64())]))),
                 pa.array([pack(data, planes)], pa.binary())], ["shard", "chunk", "n_ids", "entries", "payload"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in slices(batch):
                for d, data in zip(part.column("doc_id").to_pylist(), own.encode_all(list(texts(part.column("text"))))):
                    data += end
                    ids.append(data)
                    entries.append((d, len(data) // 4))
                    held += len(data) // 4
                    if held >= chunk_ids:
                        yield flush()
                        chunk, ids, held, entries = chunk + 1, [], 0, []
        if entries:
            yield flush()

    chunks = folder.write(ordered.mapInArrow(shard, f"shard int, chunk int, n_ids long, entries array<struct<doc_id:{kind},n:long>>, payload binary"), name, "none")
    # A row a chunk only: first the shards' starts (a row a partition), then the chunks' within each shard.
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    before = F.sum("all_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    index = chunks.select("shard", "chunk", "n_ids").join(F.broadcast(shards), "shard")  # a row a partition of the write
    index = index.select("shard", "chunk", "n_ids", (F.col("shard_start") + F.coalesce(inside, F.lit(0))).alias("start"))
    return chunks, folder.write(index, name + "_index")


def read_tokens(chunks: DataFrame, index: DataFrame, first: int | None = None, stop: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of the documents in the files.

    With ``first`` or ``stop`` only chunks that hold ids in that range are read.
    """
    if first is not None:
        index = index.where(F.col("start") + F.col("n_ids") > first)
    if stop is not None:
        index = index.where(F.col("start") < stop)
    rows = chunks.select("shard", "chunk", "entries", "payload").join(index.select("shard", "chunk", "start"), ["shard", "chunk"])
    kind = chunks.schema["entries"].dataType.elementType["doc_id"].dataType.simpleString()

    def documents(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = unpack(batch.column("payload")[k].as_py())
                start, entries = batch.column("start")[k].as_py(), batch.column("entries")[k].values
                n = entries.field("n").to_numpy()
                cuts = np.r_[0, np.cumsum(n)]
                yield pa.RecordBatch.from_arrays(
                    [entries.field("doc_id"), pa.array(start + cuts[:-1]), pa.array(n), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids binary")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files and read them back."""
    return read_tokens(*write_tokens(docs, RunFolder(spark, "tokens"), tokenizer, end_id))
