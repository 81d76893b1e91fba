import random

import numpy as np
import pytest

from helpers import documents, edge_rows, prose, sha
from tillroll.llm import suffix


def brute(rows):
    least = {}
    raw = [(suffix.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - 49):
            g = b[i:i + 50]
            least[g] = min(least.get(g, d), d)
    out = []
    for (name, _), (d, b) in zip(rows, raw):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < d:
                gone[i] += 1
                gone[min(len(b), i + 50)] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((str(name), len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(rest)))
    return sorted(out)


def cases():
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (8, 12, 40, 300)]
    rows = edge_rows()
    rows[10] = (8, prose(rng, 4000))
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(4)] + [rng.choice(shared)[rng.randint(0, 20):] for _ in range(2)]
        rng.shuffle(parts)
        rows.append((1000 - k, " ".join(parts)))
    rows += [(2000, "a" * 300), (2001, "b" + "a" * 120 + "c" + "a" * 49), (2002, "a" * 49), (2003, "a" * 50), (2004, "ab" * 100), (2005, "x" + "ab" * 30)]
    rows += [(3000, shared[3]), (3001, shared[3]), (3001, shared[3] + "!"), (3002, shared[3][:-1] + "é"), (None, shared[2])]
    return rows


def test_matches_brute_force(spark):
    rows = cases()
    got = suffix.remove_repeats(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_steps_cut_nothing(spark, monkeypatch):
    """Texts over several computing steps are treated as one."""
    rng = random.Random(7)
    a, b = prose(rng, 3000), prose(rng, 2000)
    data = np.frombuffer((a + b).encode(), np.uint8)
    cuts = np.array([0, len(a.encode()), len(data)])
    whole = suffix.phrase_starts(data, cuts)
    valid = np.ones(len(data), bool)
    runs = [np.concatenate(x) for x in zip(*suffix.anchor_runs(data, valid))]
    monkeypatch.setattr(suffix, "_STEP", 999)
    assert all(np.array_equal(x, y) for x, y in zip(whole, suffix.phrase_starts(data, cuts)))
    cut = [np.concatenate(x) for x in zip(*suffix.anchor_runs(data, valid))]
    per_string = lambda r: np.repeat(r[0], r[3] - r[2] + 1)
    assert np.array_equal(per_string(runs), per_string(cut))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 20, 31])
def test_rolling_hash_is_a_function_of_the_window(k):
    data = np.random.default_rng(k).integers(0, 3, 500).astype(np.uint8)
    h = suffix.rolling_hash(data, k)
    assert len(h) == len(data) - k + 1
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(data[i:i + k].tobytes(), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)
    assert len(suffix.rolling_hash(data[:k - 1], k)) == 0


def test_phrases_cover_every_string_once():
    data = np.frombuffer(prose(random.Random(1), 4000).encode(), np.uint8)
    cuts = np.array([0, 40, 40, 1000, 1000, 1049, 1099, len(data)])
    start, n = suffix.phrase_starts(data, cuts)
    covered = np.zeros(len(data), int)
    for a, k in zip(start, n):
        covered[a:a + k] += 1
    want = np.zeros(len(data), int)
    for a, b in zip(cuts, cuts[1:]):
        want[a:max(a, b - 49)] = 1
    assert np.array_equal(covered, want)


def test_empty_table(spark):
    assert suffix.remove_repeats(documents(spark, [])).count() == 0
