"""Conversation prefix trie, screened by a count-min sketch.

The first d turns of a conversation stand by a 128-bit digest: the XOR of the hashes of (turn, place), so that digests of all prefixes are running
XORs and a conversation with a large share of all turns is cut in chunks of ``CHUNK`` turns that are joined by their totals.

A count-min sketch of all prefix digests (two rows of counters that stop at 2) says how many conversations share a prefix at most.  An
estimate of one proves a singleton: no other conversation starts so, nor with anything longer.  These nodes, the
tails, are emitted where they lie.  Only prefixes that may be shared, and the root, are shuffled and grouped exactly.
The sketch grows with the prefixes up to ``CELLS`` counters a row, which is what bounds the broadcast; a sketch that
is too full for its corpus sends more prefixes to the exact grouping and changes no result.

Each node belongs to its least member, and what a conversation owns is the end of its path.  So sums over a subtree are sums over the
node's members of one number each: how many leaves and children the member owns, and the words of the turns before those it owns.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.joins import join_counted

from .common import RunFolder, col

#: Turns of a conversation that one window works on; counters in a row of the sketch, least and most; counters in a block of it; ids in a piece.
CHUNK, LEAST, CELLS, BLOCK, PIECE = 1 << 14, 1 << 16, 1 << 24, 1 << 14, 1 << 10
_ROWS = ("x1", "x2")
_EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(convs: DataFrame, block: int = 20, heads: int = 4, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            run: RunFolder | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv, len) of each, and its turns (conv, len, k from 1, t1, t2, w).

    Conversation c gets the first h turns of the one at the start of its block of ids, then its own turns after its first h, with
    h = crc32(c) % ``heads``; ``heads=1`` leaves conversations as they are.  t1 and t2 are hashes of role and text, w the words of the text.
    Turns are ordered by ``turn`` (nulls first), ties by their hashes; repeated rows are turns of their own; null roles and texts are
    empty.  Rows without an id belong to no conversation.
    """
    run = run or RunFolder(convs.sparkSession, "trie")
    said = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = convs.where(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv"), col(turn).alias("turn"), F.xxhash64(*said).alias("t1"), F.xxhash64(F.lit("second"), said[1], said[0]).alias("t2"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"), F.monotonically_increasing_id().alias("u"))
    order = ["conv", "turn", "t1", "t2", "u"]
    rows = run.write(rows, "turns").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = run.write(rows.select("conv", "at", "t1", "t2", "w"), "ordered")
    run.drop("turns")

    # Places count on from part to part of the range partitioning: a conversation has at most one row a part here.
    part = F.shiftright("at", 33)
    own, before = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(own))
    parts = parts.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads).withColumn("block", F.col("conv") - F.pmod("conv", F.lit(block)))
    bases = parts.where("conv = block and before = 0").select("block", F.col("total").alias("base"))
    parts = parts.join(bases, "block", "left").withColumn("m", F.least("h", F.coalesce("base", F.lit(0)))).drop("base")
    parts = run.write(parts.withColumn("len", F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "parts")

    placed = rows.withColumn("part", part).join(parts.select("conv", "part", "first", "before", "h", "m", "len", "block"), ["conv", "part"])
    placed = placed.withColumn("i", F.col("at") - F.col("first") + F.col("before"))
    mine = placed.where("i >= h").select("conv", "len", (F.col("m") + F.col("i") - F.col("h") + 1).alias("k"), "t1", "t2", "w")
    begun = placed.where((F.col("conv") == F.col("block")) & (F.col("i") < heads - 1)).select("block", "i", "t1", "t2", "w")
    taken = parts.where("before = 0 and h > 0").select("block", "conv", "len", "h").join(begun, "block").where("i < h")
    taken = taken.select("conv", "len", (F.col("i") + 1).alias("k"), "t1", "t2", "w")
    return parts.where("before = 0").select("conv", "len"), mine.unionByName(taken)


def _prefixes(turns: DataFrame, run: RunFolder, chunk: int) -> DataFrame:
    """conv, len, k, w, p (words of the first k turns), the digest x1, x2, and the turn's part of it, l1, l2."""
    rows = turns.withColumn("chunk", F.floor(F.col("k") / chunk)).withColumn("l1", F.xxhash64("t1", "t2", "k")).withColumn("l2", F.xxhash64("k", "t2", "t1"))
    upto = Window.partitionBy("conv", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv", "len", "k", "chunk", "w", "l1", "l2", F.sum("w").over(upto).alias("p"), F.bit_xor("l1").over(upto).alias("x1"), F.bit_xor("l2").over(upto).alias("x2"))
    rows = run.write(rows, "prefixes")
    over = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where(F.col("len") >= chunk).groupBy("conv", "chunk").agg(F.sum("w").alias("w"), F.bit_xor("l1").alias("l1"), F.bit_xor("l2").alias("l2"))
    totals = totals.select("conv", "chunk", F.sum("w").over(over).alias("cp"), F.bit_xor("l1").over(over).alias("c1"), F.bit_xor("l2").over(over).alias("c2"))
    later = rows.where(F.col("k") >= chunk).join(totals, ["conv", "chunk"])
    out = ["conv", "len", "k", "w", "l1", "l2"]
    later = later.select(*out, (F.col("p") + F.col("cp")).alias("p"), F.col("x1").bitwiseXOR(F.col("c1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("x2"))
    return rows.where(F.col("k") < chunk).select(*out, "p", "x1", "x2").unionByName(later)


def _cells(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64) & np.uint64(width - 1)


def shared_cells(digests: DataFrame, width: int) -> list[np.ndarray]:
    """The count-min sketch of all digests, as one array of booleans a row: has the counter reached 2?"""
    def count(batches):
        cells = np.zeros((2, width), np.uint8)
        for batch in batches:
            for row, name in zip(cells, _ROWS):
                where, n = np.unique(_cells(batch, name, width), return_counts=True)
                row[where] = np.minimum(2, row[where] + np.minimum(2, n).astype(np.uint8))
        for r, row in enumerate(cells):
            used = [b for b, x in enumerate(row.reshape(-1, BLOCK).any(axis=1)) if x]
            for at in range(0, len(used), 256):
                some = used[at:at + 256]
                bits = [[np.packbits(row[b * BLOCK:(b + 1) * BLOCK] >= least).tobytes() for b in some] for least in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(bits[0]), pa.array(bits[1])], ["r", "b", "one", "two"])

    def merged(batches):
        at, one, two = None, None, None
        for batch in batches:
            for key, *got in zip(zip(*(batch.column(c).to_pylist() for c in ("r", "b"))), batch.column("one"), batch.column("two")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in got)
                if key != at:
                    if at:
                        yield _block(at, two)
                    at, one, two = key, a.copy(), b.copy()
                else:
                    two |= b | (one & a)
                    one |= a
        if at:
            yield _block(at, two)

    parts = digests.select(*_ROWS).mapInArrow(count, "r int, b int, one binary, two binary")
    blocks = parts.repartition("r", "b").sortWithinPartitions("r", "b").mapInArrow(merged, "r int, b int, two binary")
    cells = [np.zeros(width // 8, np.uint8) for _ in _ROWS]
    for x in blocks.toArrow().to_pylist():  # at most 2 x CELLS bits
        cells[x["r"]][x["b"] * BLOCK // 8:(x["b"] + 1) * BLOCK // 8] = np.frombuffer(x["two"], np.uint8)
    return cells


def _block(key: tuple, two: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([two.tobytes()])], ["r", "b", "two"])


def _screened(prefixes: DataFrame, width: int, run: RunFolder) -> DataFrame:
    """Prefixes with shared (the estimate is two or more) and top (a singleton whose parent may be shared)."""
    cells = prefixes.sparkSession.sparkContext.broadcast(shared_cells(prefixes, width))
    out = ["conv", "len", "k", "w", "p", "x1", "x2"]

    def screen(batches):
        bits = [np.unpackbits(x).view(bool) for x in cells.value]
        for batch in batches:
            own = [_cells(batch, name, width) for name in _ROWS]
            turn = [batch.column(name).to_numpy().view(np.uint64) & np.uint64(width - 1) for name in ("l1", "l2")]
            shared = bits[0][own[0]] & bits[1][own[1]]
            above = bits[0][own[0] ^ turn[0]] & bits[1][own[1] ^ turn[1]] | (batch.column("k").to_numpy() == 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(shared), pa.array(~shared & above)], [*out, "shared", "top"])

    rows = prefixes.mapInArrow(screen, ", ".join(f"{c} long" for c in out) + ", shared boolean, top boolean")
    return run.write(rows, "screened")


def _ends(members: DataFrame) -> DataFrame:
    """x1, x2, ends: digest of the ascending ids of the conversations that end at a node.

    A range partitioning spreads a node with many ends; its ids are then read as pieces, one after the other, never as a whole.
    """
    def pieces(batches):
        key, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, ids[0])] + [pa.array([",".join(map(str, ids)).encode()])], ["x1", "x2", "first", "ids"])

        for batch in batches:
            x1, x2, conv = (batch.column(c).to_numpy() for c in ("x1", "x2", "conv"))
            cuts = np.flatnonzero((x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x1)]):
                if a == b:
                    continue
                own = (int(x1[a]), int(x2[a]))
                if key != own:
                    if ids:
                        yield piece()
                    key, ids = own, []
                ids += conv[a:b].tolist()
                while len(ids) >= PIECE:
                    ids, rest = ids[:PIECE], ids[PIECE:]
                    yield piece()
                    ids = rest
        if ids:
            yield piece()

    def digests(batches):
        key, sha = None, None
        for batch in batches:
            done = []
            for x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "ids"))):
                if key == (x1, x2):
                    sha.update(b"," + ids)
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (x1, x2), hashlib.sha256(ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["x1", "x2", "ends"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, sha.hexdigest())], ["x1", "x2", "ends"])

    ends = members.where("k = len").select("x1", "x2", "conv").repartitionByRange("x1", "x2", "conv").sortWithinPartitions("x1", "x2", "conv")
    ends = ends.mapInArrow(pieces, "x1 long, x2 long, first long, ids binary")
    return ends.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInArrow(digests, "x1 long, x2 long, ends string")


def _sum(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def prefix_trie(sequences: DataFrame, turns: DataFrame, chunk: int = CHUNK, cells: int = CELLS, run: RunFolder | None = None) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv, len) and their ``turns`` (conv, len, k, t1, t2, w), as ``rebuilt`` gives them.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; the root has depth 0 and no parent.
    Conversations of the same turns are members of the same nodes; one without turns ends at the root.  No conversation: no node.
    """
    run = run or RunFolder(turns.sparkSession, "trie")
    prefixes = _prefixes(turns, run, chunk)
    width = min(cells, max(LEAST, 1 << (4 * prefixes.count()).bit_length()))
    screened = _screened(prefixes, width, run)
    zero = F.lit(0).cast("long")
    root = sequences.select("conv", "len", *[zero.alias(c) for c in ("k", "w", "p", "x1", "x2")])
    members = screened.where("shared").select(*root.columns).unionByName(root)
    groups = members.groupBy("x1", "x2").agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.max("len").alias("deepest"))
    members = run.write(join_counted(members, run.write(groups, "groups"), ["x1", "x2"], "n"), "members")

    mine = F.col("least") == F.col("conv")
    owners = members.groupBy("conv").agg(F.max(F.when(~mine, F.struct("k", "least", "p"))).alias("o"), F.max(F.when(F.col("k") == F.col("len"), mine & (F.col("deepest") == F.col("len")))).alias("leaf"),
                                         F.max("k").alias("most"))
    owners = owners.select("conv", F.coalesce(F.col("o.k") + 1, F.lit(0)).alias("own"), F.col("o.least").alias("up"), F.coalesce("o.p", F.lit(0)).alias("lead"), F.coalesce("leaf", F.lit(True)).alias("leaf"), "most")
    owners = run.write(owners, "owners")
    # One row for each chunk of a conversation's shared turns, so that a long one isn't a hot key.
    spread = owners.select("conv", "own", "lead", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("most") / chunk))).alias("chunk"))
    known = members.withColumn("chunk", F.floor(F.col("k") / chunk)).join(spread, ["conv", "chunk"])
    child = (F.col("own") <= F.col("k") + 1) & (F.col("k") + 1 <= F.col("len"))
    nodes = known.groupBy("x1", "x2").agg(
        F.min("least").alias("conv_id"), F.min("k").alias("depth"), F.count("*").alias("n_convs"), _sum(child).alias("n_children"), _sum(F.col("leaf")).alias("n_leaves"),
        (F.coalesce(F.sum(F.when(~mine, F.col("lead"))), F.lit(0)) - (F.count("*") - 1) * F.min(F.col("p") - F.col("w"))).alias("saved_tokens"))
    nodes = nodes.join(_ends(members), ["x1", "x2"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY)))

    one = F.lit(1).cast("long")
    ends_here = F.when(F.col("k") == F.col("len"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY))
    tails = screened.where("not shared").select(F.col("conv").alias("conv_id"), F.col("k").alias("depth"), one.alias("n_convs"), (F.col("k") < F.col("len")).cast("long").alias("n_children"),
                                                one.alias("n_leaves"), zero.alias("saved_tokens"), ends_here.alias("ends_sha256"), "top")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = tails.where("not top").withColumn("parent_conv_id", F.col("conv_id")).select(*out)
    # Where a conversation's own nodes begin, the parent belongs to another.
    heads = nodes.drop("x1", "x2", "ends").unionByName(tails.where("top").drop("top"))
    heads = heads.join(owners.where("own > 0").select(F.col("conv").alias("conv_id"), F.col("own").alias("depth"), "up"), ["conv_id", "depth"], "left")
    return heads.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))).select(*out).unionByName(below)


def conversation_trie(convs: DataFrame, block: int = 20, heads: int = 4, chunk: int = CHUNK, cells: int = CELLS, **columns: str) -> DataFrame:
    """``prefix_trie`` over the ``rebuilt`` conversations; see both for what nulls, ties, repeated rows and empty tables give."""
    run = RunFolder(convs.sparkSession, "trie")
    sequences, turns = rebuilt(convs, block, heads, run=run, **columns)
    return prefix_trie(sequences, turns, chunk, cells, run)
