"""Alignment of two tokenizers' tokens over whole texts.

Both tokenizers encode a blank and the text; B, a sentencepiece model, adds the blank itself.  A text is encoded in chunks that begin at a blank
(space or line feed) after a non-blank: the split pattern of A never reaches over such a place, and no piece of B holds a blank after a
non-blank (``Aligner`` checks this), so a text's ids are its chunks' ids, and a chunk that was seen lately is not encoded again.

Both sides' tokens end where a chunk ends, so that a text's groups and links are its chunks' groups and links too: what a chunk gives, from its ids to
the text of its groups, is worked out once for each chunk that was not seen lately, in bulk, and a text takes one look-up a chunk.

How often an id pair is linked in the corpus is summed by Spark from each document's distinct pairs.  The
counts go back to the documents in shards of at most ``SHARD`` pairs: the number of pairs is bounded by the two vocabularies and not by the corpus,
a shard's size by its definition, and each shard is a scan of its own, so no task holds two.
"""
from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress, islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import latin_split
from .chunks import BLANK, byte_chars
from .common import RunFolder, packed, slices, texts

#: Pairs of a shard; entries of a memory; chunks that are handled at a time; chunks that are encoded as one text.
SHARD, REMEMBER, PART, TOGETHER = 1 << 21, 1 << 17, 200_000, 2048
_OTHER = BLANK.replace(r"\t-\r ", r"\t\x0b-\r")
CHUNK = re.compile(rf"[ \n][{BLANK}]*[^{BLANK}]+(?:[{_OTHER}][{BLANK}]*[^{BLANK}]+)*(?:[{_OTHER}][{BLANK}]*\Z)?|[ \n][{BLANK}]*\Z")

#: What is remembered of a chunk.
_GROUPS, _LINKS, _N_A, _N_B = map(itemgetter, range(4))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ABSENT = object()


class Recent:
    """Values of keys, made in bulk; of two generations the older one is forgotten when the younger is full."""

    def __init__(self, make_all, limit: int = REMEMBER):
        self.make_all, self.limit, self.young, self.old = make_all, limit, {}, {}

    def values(self, keys: list) -> list:
        young = self.young
        out = list(map(young.get, keys, repeat(_ABSENT)))
        places = [k for k, x in enumerate(out) if x is _ABSENT]
        if places:
            missing, old = {keys[k] for k in places}, self.old
            young.update((x, old[x]) for x in missing if x in old)
            new = [x for x in missing if x not in old]
            young.update(zip(new, self.make_all(new)))
            for k in places:
                out[k] = young[keys[k]]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


class Aligner:
    """Two vocabularies, their tokens' bytes, and what was worked out lately."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(self.chars)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        if any(re.search(rb"[^ ] |\n.|.\n", x, re.DOTALL) for k, x in enumerate(b_bytes) if not self.b.is_byte(k)):
            raise ValueError("the second vocabulary has pieces with a blank inside: texts can't be cut before blanks")
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        names = [str(k).encode() + end for side, last in zip(self.bytes, (b"|", b";")) for k in range(len(side)) for end in (b",", last)]
        self.names, self.name_lengths, self.starts = names, np.array([len(x) for x in names]), (0, 2 * len(a_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.split, self.translate = latin_split(pattern), dict(enumerate(self.chars))
        self.pieces, self.chunks = Recent(self._pieces), Recent(self._chunks, 2 * REMEMBER)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        tokenize, translate = self.a.model.tokenize, self.translate
        return [array("i", [t.id for t in tokenize(x.encode().decode("latin-1").translate(translate))]).tobytes() for x in pieces]

    def _chunks(self, chunks: list[str]) -> list[tuple]:
        """Groups as text, links, and both sides' numbers of tokens; an empty tuple where the joined bytes aren't the chunk's."""
        out, latin = [()] * len(chunks), [x.isascii() or _is_latin(x) for x in chunks]
        for kind in (True, False):
            places = [k for k, x in enumerate(latin) if x is kind]
            for at in range(0, len(places), TOGETHER):
                some = places[at:at + TOGETHER]
                own = [chunks[k] for k in some]
                good, ids, sizes = self._together(own, kind) or self._apart(own, kind)
                for k, x in zip(compress(some, good), self._aligned(ids, sizes)):
                    out[k] = x
        return out

    def _ids_a(self, texts: list[str], latin: bool) -> list[bytes]:
        if not latin:
            return [array("i", x.ids).tobytes() for x in self.a.encode_batch(texts, add_special_tokens=False)]
        cut = [self.split.findall(x) for x in texts]
        found = iter(self.pieces.values([p for own in cut for p in own]))
        return [b"".join(islice(found, len(own))) for own in cut]

    def _together(self, chunks: list[str], latin: bool) -> tuple | None:
        """Which chunks are good (all), the ids of both sides and how many each chunk has, encoded as one text whose chunks they are.

        None where they aren't that text's chunks (one ends with a blank), or its joined bytes differ."""
        own = [" a", *chunks]  # a text begins with a blank, a chunk maybe with a line feed
        if CHUNK.findall(whole := "".join(own)) != own:
            return None
        raw = self._ids_a([whole], latin)[0], array("i", self.b.encode(whole[1:])).tobytes()
        if not self._joined([raw]) == (text := whole.encode(), text):
            return None
        upto = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in own])
        ids, sizes = [], []
        for x, length in zip(raw, self.lengths):
            x = np.frombuffer(x, np.int32)
            ends = np.cumsum(length[x])
            cuts = np.searchsorted(ends, upto)
            if (ends[cuts] != upto).any():
                return None
            ids.append(x[cuts[0] + 1:])
            sizes.append(np.diff(cuts))
        return repeat(True), ids, sizes

    def _apart(self, chunks: list[str], latin: bool) -> tuple:
        """The same, encoded one by one; bad chunks are left out of the ids and sizes."""
        left = self._ids_a(chunks, latin)
        right = self.b.encode([x[1:] if x[0] == " " else x for x in chunks], num_threads=1)
        right = [(ids or [self.blank]) if x[0] == " " else ids[1:] if ids[0] == self.blank else [] for x, ids in zip(chunks, right)]
        found = list(zip(left, [array("i", ids).tobytes() for ids in right]))
        good = [self._joined([x]) == (r := c.encode(), r) for x, c in zip(found, chunks)]
        found = list(compress(found, good))
        return good, [np.frombuffer(b"".join([x[k] for x in found]), np.int32) for k in (0, 1)], [np.array([len(x[k]) // 4 for x in found], np.int64) for k in (0, 1)]

    def _joined(self, sides: list[tuple[bytes, bytes]]) -> tuple[bytes, ...]:
        """The bytes of both sides' tokens."""
        return tuple(b"".join(map(table.__getitem__, memoryview(b"".join([x[k] for x in sides])).cast("i"))) for k, table in enumerate(self.bytes))

    def _aligned(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> list[tuple[bytes, bytes, int, int]]:
        """Groups as text, links as pairs (B id in the upper half) and both sides' numbers of tokens of each chunk, of all of them at once.

        Between two neighbouring ends, of either side, lies one A-B pair of overlapping tokens, and each pair once."""
        if not len(sizes[0]):
            return []
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, ids)]
        marks = np.zeros((2, ends[0][-1] + 1), bool)
        for mark, x in zip(marks, ends):
            mark[x] = True
        each, shared = np.flatnonzero(marks.any(axis=0)), np.flatnonzero(marks.all(axis=0))
        of_a, of_b = (np.searchsorted(x, each) for x in ends)
        links = (ids[1][of_b].astype(np.int64) << 32 | ids[0][of_a]).tobytes()
        # The tokens of a group, A before B, each with what follows it.
        order = np.argsort(np.concatenate([np.searchsorted(shared, x) * 2 + k for k, x in enumerate(ends)]), kind="stable")
        codes = np.concatenate([start + 2 * x + mark[end] for start, x, mark, end in zip(self.starts, ids, marks[::-1], ends)])[order]
        text = b"".join(map(self.names.__getitem__, codes.tolist()))
        upto = [np.cumsum(x) for x in sizes]
        text_cuts = np.r_[0, np.cumsum(self.name_lengths[codes])[upto[0] + upto[1] - 1]].tolist()
        link_cuts = np.r_[0, (np.searchsorted(each, ends[0][upto[0] - 1]) + 1) * 8].tolist()
        return [(text[p:q - 1], links[r:s], *n) for p, q, r, s, *n in zip(text_cuts, text_cuts[1:], link_cuts, link_cuts[1:], *(x.tolist() for x in sizes))]

    def align_all(self, texts: list[str], digest: bool) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups, pairs and how often each is linked, of each whole text."""
        cut = [CHUNK.findall(" " + x) if x and len(x) < PART else [] for x in texts]
        found = iter(self.chunks.values([x for own in cut for x in own]))
        parts = [[list(islice(found, len(own)))] if own else [] for own in cut]
        return [self._summed(own if len(x) < PART else self._long(x), digest) for x, own in zip(texts, parts)]

    def _long(self, text: str) -> Iterator[list[tuple]]:
        """What the chunks of one text give, in parts."""
        found = CHUNK.finditer(" " + text)
        while some := [m[0] for m in islice(found, PART)]:
            yield self.chunks.values(some)

    def _summed(self, parts: Iterable[list[tuple]], digest: bool) -> tuple:
        sha, kept, links, n_a, n_b, n_groups = hashlib.sha256(), [], [], 0, 0, 0
        for k, own in enumerate(parts):
            if not all(own):
                return self._summed([], digest)
            groups = b";".join(map(_GROUPS, own))
            n_groups += groups.count(b"|")
            n_a, n_b = n_a + sum(map(_N_A, own)), n_b + sum(map(_N_B, own))
            sha.update(b";" * (k > 0) + groups) if digest else kept.append(groups)
            links.append(b"".join(map(_LINKS, own)))
        pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
        groups = (sha.hexdigest() if links else "") if digest else b";".join(kept).decode()
        return n_a, n_b, n_groups, int(times.sum()), groups, pairs, times


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    """One aligner a Python worker and pair of vocabularies."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a_path, b_path, pattern)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64)))


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", keep=None, digest: bool = False) -> DataFrame:
    """row, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, or its SHA-256 in hex with ``digest``), pairs and times."""
    source = packed(docs, text, keep)
    names = ["row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches):
        own = aligner(a_path, b_path, pattern)
        for batch in batches:
            for part in slices(batch):
                got = list(zip(*own.align_all([t.decode("utf-8") for t in texts(part.column("text"))], digest)))
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, pa.int64()) for c in got[:4]), pa.array(got[4], pa.string()), _lists(got[5]), _lists(got[6])], names)

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus) and best (no pair with the same B id has more)."""
    pairs = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most as many rows as A has ids
    return pairs.withColumn("best", F.col("n") == most)


def _summed(table: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_best and count_sum, of the links whose pair is in ``counts``."""
    own = counts.orderBy("pair").toArrow()  # a shard
    shared = table.sparkSession.sparkContext.broadcast(tuple(own.column(c).to_numpy() for c in ("pair", "n", "best")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*columns).schema)

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists, times = part.column("pairs"), part.column("times").flatten().to_numpy()
                links = lists.flatten().to_numpy()
                cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
                sums = []
                if len(pair):
                    where = np.minimum(np.searchsorted(pair, links), len(pair) - 1)
                    there = (pair[where] == links) * times
                    values = there * best[where], there * n[where]
                else:
                    values = np.zeros_like(links), np.zeros_like(links)
                for value in values:
                    total = np.r_[0, np.cumsum(value)]
                    sums.append(pa.array(total[cuts[1:]] - total[cuts[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *sums], [*columns, "n_best", "count_sum"])

    return table.select(*dict.fromkeys([*columns, "pairs", "times"])).mapInArrow(run, f"{schema}, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", keep=None, digest: bool = False, shard: int = SHARD) -> DataFrame:
    """row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, for every row.

    Null and empty texts, and those whose tokens' bytes on either side aren't the blank and the text, have no tokens: zeros and no groups.
    Strings of special tokens inside a text are plain text.  Ties: every pair with its B id's highest count is a best one.  Repeated rows
    are aligned and counted each.  An empty table gives an empty one; the input's columns come back inside ``row``.
    """
    run = RunFolder(docs.sparkSession, "align")
    table = run.write(aligned(docs, a_path, b_path, pattern, text, keep, digest).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = run.write(pair_counts(table), "pairs")
    shards = max(1, -(-counts.count() // shard))
    columns = ["row", "n_a", "n_b", "n_groups", "n_links", "groups"]
    if shards == 1:
        out = _summed(table, counts, columns)
    else:
        sums = None
        for k in range(shards):
            own = _summed(table, counts.where(F.pmod(F.xxhash64("pair"), F.lit(shards)) == k), ["rid"])
            sums = own if sums is None else sums.unionByName(own)
        sums = sums.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = table.select("rid", *columns).join(sums, "rid")
    return out.select("row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
