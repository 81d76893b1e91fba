"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library's byte-level form of a vocabulary writes every byte as one printable character.  The vocabulary
and its merges are rebuilt from a rank file: a token's two parts are what the lower ranks
make of its bytes.  Texts are cut in chunks of blanks and the word after them, over whose ends no match of the split
pattern reaches, and each distinct chunk is encoded once (``chunks.py``).

Decoding reverses the byte table: ids become bytes, and bytes text.  A character may
be split over tokens; offsets then give each of its tokens the whole character.
"""
from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import BLANK, LETTER, NUMBER, ChunkEncoder, byte_chars
from .common import per_text

_CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


def latin_split(pattern: str) -> re.Pattern:
    """A split pattern for Python's ``re``, right for texts of Latin-1 characters."""
    for name, chars in ((r"[^\s\p{L}\p{N}]", f"[^{BLANK}{LETTER}{NUMBER}]"), (r"\p{L}", f"[{LETTER}]"), (r"\p{N}", f"[{NUMBER}]"), (r"\s", f"[{BLANK}]"), (r"\S", f"[^{BLANK}]")):
        pattern = pattern.replace(name, chars)
    return re.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """What the ranks below ``limit`` make of a token's bytes."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while True:
        best = min(((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(limit, 0))
        if best[0] >= limit:
            return parts
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(ranks_path), byte_chars()
        name = lambda token: "".join(chars[b] for b in token)
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = _parts(token, ranks, rank)
                if len(parts) == 2:
                    merges.append((name(parts[0]), name(parts[1])))
        tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.chunks = ChunkEncoder(tokenizer, _CHUNK, latin_split(pattern))

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each whole text."""
        return [np.frombuffer(x, np.uint32) for x in self.chunks.encode_all(texts)]

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for (an id outside the table: an error)."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            some = ids[at:at + (1 << 18)]
            size = self.lengths[some]
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) + np.repeat(self.starts[some] - (ends - size), size)
            out.append(self.bytes[where].tobytes())
        return b"".join(out)

    def char_offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one character of every token; a token that holds part of a character spans all of it."""
        if len(ids) == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        ends = np.cumsum(self.lengths[ids])
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        first = chars[ends - self.lengths[ids]] - 1
        return first.astype(np.int32), chars[ends - 1].astype(np.int32)


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a Python worker and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(ranks_path, pattern)


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False, keep=None) -> DataFrame:
    """``row`` and ids (array<int>); with ``offsets`` also char_start and char_end of every token.

    Every whole text is encoded without special tokens; strings of such tokens are
    ordinary text.  Null and empty texts have no ids; each row counts as given; an empty table gives an empty one.
    """
    def make():
        own = codec(ranks_path, pattern)

        def work(part):
            ids = own.encode_all(part)
            out = {"ids": _lists(ids, pa.int32())}
            if offsets:
                both = [own.char_offsets(i, t) for i, t in zip(ids, part)]
                out |= {"char_start": _lists([x[0] for x in both], pa.int32()), "char_end": _lists([x[1] for x in both], pa.int32())}
            return out
        return work

    return per_text(docs, make, "ids array<int>" + ", char_start array<int>, char_end array<int>" * offsets, text, keep)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, keep=("row",)) -> DataFrame:
    """The kept columns, ids and decoded (binary: bytes may end inside a character); null ids: no bytes."""
    source = encoded.select(*keep, "ids")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema) + ", decoded binary"

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [own.decode(ids.values.to_numpy()) if ids.is_valid else b"" for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    return source.mapInArrow(run, schema)
