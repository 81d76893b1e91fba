"""The prefix trie against one built of nested dictionaries."""
import random
import zlib
from collections import defaultdict

import pytest
from helpers import sha
from pyspark.sql import functions as F
from tillroll.llm import trie
from tillroll.llm.common import RunFolder

SCHEMA = "conv_id long, turn long, role string, text string, row string, k string, n string, x1 string"


def brute(rows, block=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = tuple(own.get(c - c % block, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        words = len([x for x in p[-1][1].replace("\x1c", "_").replace("\x85", "_").replace("\xa0", "_").split()]) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   sha(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)))) for p, m in members.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "row!", "k!", "n!", "x1!") for r in rows], SCHEMA)


def mixed(rng, n):
    """Conversations of few different turns, so that many share beginnings, some all."""
    said = ["", "a b", "one\ttwo three", "né \x85 x\xa0y", None, "word " * 50]
    out = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # absent, also as the start of a block
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            out.append((c, t, rng.choice(["user", "assistant", None]) if t else "system", rng.choice(said[:2 + t % 5])))
    return out


def test_matches_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = mixed(rng, 300)
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (7, 0, "system", "tie b"), (7, 0, "system", "tie a"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    got = nodes(trie.conversation_trie(table(spark, rows)))
    # Ties are ordered by hash: the two texts of conversation 7 may stand either way.
    assert got in (brute(rows), brute([(c, t, r, {"tie b": "tie a", "tie a": "tie b"}.get(x, x)) for c, t, r, x in rows]))


@pytest.mark.parametrize("chunk,cells", [(2, 1 << 16), (trie.CHUNK, 1 << 16), (3, 1 << 14)])
def test_chunks_and_a_full_sketch_change_nothing(spark, monkeypatch, chunk, cells):
    if cells < trie.LEAST:
        monkeypatch.setattr(trie, "LEAST", cells)
    rows = mixed(random.Random(2), 200)
    assert nodes(trie.conversation_trie(table(spark, rows), chunk=chunk, cells=cells)) == brute(rows)


def test_long_and_copied_conversations(spark):
    rng = random.Random(3)
    long = [("user", f"turn {k} {rng.random()}") for k in range(5000)]
    rows = [(c, t, *long[t]) for c, n in ((0, 5000), (100, 5000), (140, 4000), (160, 2500)) for t in range(n)]
    rows += [(1000 + 20 * k, 0, "user", "copy") for k in range(3000)]
    got = nodes(trie.conversation_trie(table(spark, rows).repartition(7), heads=1, chunk=256))
    assert got == brute(rows, heads=1)


def test_empty_table_and_single_conversation(spark):
    assert nodes(trie.conversation_trie(table(spark, []))) == []
    assert nodes(trie.conversation_trie(table(spark, [(4, 1, "user", "x")]))) == brute([(4, 1, "user", "x")])
    assert nodes(trie.conversation_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_sketch_never_underestimates(spark):
    df = spark.range(20_000).select((F.xxhash64(F.col("id") % 15_000)).alias("x1"), F.xxhash64(F.lit(1), F.col("id") % 15_000).alias("x2"))
    import numpy as np
    width = 1 << 16
    bits = [np.unpackbits(x).view(bool) for x in trie.shared_cells(df.repartition(9), width)]
    rows = df.groupBy("x1", "x2").count().collect()
    est = [bits[0][(r.x1 & (width - 1))] and bits[1][(r.x2 & (width - 1))] for r in rows]
    assert all(e for e, r in zip(est, rows) if r["count"] > 1)
    false = sum(e for e, r in zip(est, rows) if r["count"] == 1)
    assert false < 0.15 * sum(r["count"] == 1 for r in rows)


def test_only_possibly_shared_prefixes_are_grouped(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(500) for t in range(6)]
    run = RunFolder(spark, "trie-test")
    sequences, turns = trie.rebuilt(table(spark, rows), heads=1, run=run)
    assert trie.prefix_trie(sequences, turns, run=run).count() == 3001
    assert spark.read.parquet(f"{run.path}/members").where("k > 0").count() < 100
