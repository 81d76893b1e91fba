import math
import random
import re
from collections import Counter

import pytest

from helpers import documents, edge_rows, prose
from tillroll.llm import lm


def brute(rows, order=5):
    raw = [(d, (t or "").encode()) for d, t in rows]
    c = Counter(b[i:i + o] for _, b in raw for o in range(1, order + 1) for i in range(len(b) - o + 1))
    total = sum(n for g, n in c.items() if len(g) == 1)
    known = {}

    def log_s(g):
        if g not in known:
            if len(g) == 1:
                known[g] = math.log(c[g] / total)
            elif c[g] >= lm.MIN_COUNT:
                known[g] = math.log(c[g] / c[g[:-1]])
            else:
                known[g] = math.log(lm.BACKOFF) + log_s(g[1:])
        return known[g]

    return sorted((str(d), len(b), round(sum(log_s(b[max(0, i - order + 1):i + 1]) for i in range(len(b))), 5)) for d, b in raw)


@pytest.mark.parametrize("order,part_bytes", [(5, 1 << 24), (3, 4000)])
def test_matches_brute_force(spark, order, part_bytes):
    rows = edge_rows()
    rows[10] = (8, rows[10][1][:20_000])
    got = lm.score(documents(spark, rows), order=order, part_bytes=part_bytes).collect()
    want = brute(rows, order)
    have = sorted((str(r.doc_id), r.n_bytes, round(r.sum_log, 5)) for r in got)
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(have, want))


def test_blocks_cut_nothing(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    table = pa.table({"text": ["abcdefgh" * 20, "", None, "xyz", "abcabc" * 9]})
    whole = [np.sort(np.concatenate(x)) for x in zip(*lm._blocks(table, 4))]
    monkeypatch.setattr(lm, "_STEP", 7)
    assert all(np.array_equal(a, np.sort(np.concatenate(b))) for a, b in zip(whole, zip(*lm._blocks(table, 4))))


def test_empty_table_and_orders(spark):
    assert lm.score(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lm.score(documents(spark, []), order=7)


def brute_words(rows):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    one = Counter(w for _, ws in docs for w in ws)
    two = Counter(p for _, ws in docs for p in zip(ws, ws[1:]))
    total = sum(one.values())

    def log_s(a, b):
        if a is not None and two[a, b] >= lm.MIN_COUNT:
            return math.log(two[a, b] / one[a])
        return (0 if a is None else math.log(lm.BACKOFF)) + math.log(one[b] / total)

    return sorted((str(d), len(ws), sum(log_s(a, b) for a, b in zip([None, *ws], ws))) for d, ws in docs)


@pytest.mark.parametrize("blocks", [1, 3])
def test_words_match_brute_force(spark, blocks):
    rows = edge_rows()
    have = sorted((str(r.doc_id), r.n_words, r.sum_log) for r in lm.word_score(documents(spark, rows), blocks=blocks).collect())
    want = brute_words(rows)
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2])) for a, b in zip(have, want))
    assert lm.word_score(documents(spark, [])).count() == 0


def test_shuffled_words_lose_evidence(spark):
    """Bytes hardly tell a text from the same words in another order; words do."""
    rng = random.Random(4)
    vocabulary = prose(rng, 300).split()
    line = " ".join(rng.choices(vocabulary, k=400))
    mixed = line.split()
    rng.shuffle(mixed)
    docs = documents(spark, [(1, line), (2, line), (3, " ".join(mixed))])
    got = {r.doc_id: r.sum_log / r.n_words for r in lm.word_score(docs).collect()}
    assert got[1] == got[2] > got[3] + 2
