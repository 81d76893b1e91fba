import random

import numpy as np
import xxhash

from helpers import Union, documents, edge_rows, words3
from tillroll.llm import simhash
from tillroll.llm.common import RunFolder
from tillroll.llm.components import connected_components


def brute_fp(text, k=3):
    w = words3(text)
    parts = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_brute_force_even_in_pieces():
    for _, text in edge_rows():
        assert simhash.fingerprint((text or "").encode()) == brute_fp(text)
    long = edge_rows()[10][1] * 6  # over a piece
    assert len(long) > 1 << 20 and simhash.fingerprint(long.encode()) == brute_fp(long)


def test_every_pair_within_the_radius_collides_under_some_mask():
    rng = random.Random(1)
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & m == 0 for m in masks)


def test_components_match_all_pairs_also_through_large_buckets(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 3)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centre for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    own = Union()
    arr = np.array(signed, np.int64)
    near = np.bitwise_count((arr[:, None] ^ arr[None, :]).view(np.uint64)) <= 3
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        own.join(signed[i], signed[j])
    run = RunFolder(spark, "test")
    links = simhash.covering_links(spark.createDataFrame([(x,) for x in signed], "fp long"), run, 3, bucket=16)
    roots = {r.u: r.root for r in connected_components(links, run).collect()}
    assert all(roots.get(x, x) == own.find(x) for x in signed)


def test_near_duplicates_over_edge_rows(spark):
    rows = edge_rows()
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = [brute_fp(t) for _, t in rows]
    own = Union()
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                own.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(own.find(i), []).append(d)
    want = sorted((str(d), min((x for x in ids[own.find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want


def test_deduplicate_keeps_columns_and_one_row_a_group(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs).select("root").distinct().count()
    got = kept.collect()
    assert len(got) == groups and sum(r.doc_id == 1 for r in got) == 1 and not any(r.doc_id == 4 for r in got)


def test_empty_table_and_no_links(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (5000, 4999), (4999, 5000)]
    roots = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), RunFolder(spark, "test")).collect()}
    assert all(roots[i] == 0 for i in range(1, 61)) and all(roots[1000 + i] == 1000 for i in range(1, 300)) and roots[5000] == 4999
    assert len(roots) == 60 + 299 + 1


def test_deduplicate_decides_ties_by_the_rows_themselves(spark):
    rows = [(1, "one text of some words", source) for source in "cab"] + [(1, "one text of some words", None), (2, "one text of some words", "a")]
    kept = {tuple(simhash.deduplicate(spark.createDataFrame(own, "doc_id long, text string, source string").coalesce(1)).collect()) for own in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1 and len(next(iter(kept))) == 1 and next(iter(kept))[0].doc_id == 1
