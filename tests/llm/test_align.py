"""Token alignment against plain library calls over whole texts."""
import random
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
from helpers import documents, edge_rows, prose, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillroll.llm import align
from tillroll.llm.chunks import byte_chars

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@lru_cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {c: b for b, c in enumerate(byte_chars())}


def tokens(text):
    """(ids of A, ids of B, their bytes), or none."""
    a, b, byte_of = libraries()
    if not text:
        return [], [], [], []
    ids = a.encode(" " + text, add_special_tokens=False)
    left = [bytes(byte_of[c] for c in t) for t in ids.tokens]
    right_ids = b.encode(text)
    right = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in right_ids]
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return [], [], [], []
    return ids.ids, right_ids, left, right


def spans(parts):
    out, at = [], 0
    for x in parts:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute_one(text):
    a, b, left, right = tokens(text)
    sa, sb = spans(left), spans(right)
    links = []
    for i, (p, q) in enumerate(sa):
        links += [(a[i], b[j]) for j, (r, s) in enumerate(sb) if r < q and p < s]
    groups, i, j = [], 0, 0
    for end in sorted({x[1] for x in sa} & {x[1] for x in sb}):
        m = next(k for k in range(i, len(sa)) if sa[k][1] == end) + 1
        n = next(k for k in range(j, len(sb)) if sb[k][1] == end) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    return len(a), len(b), groups, links


def brute(rows):
    ones = [brute_one(t) for _, t in rows]
    counts = Counter(x for o in ones for x in o[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(na, nb, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(g)) for na, nb, g, links in ones]


CASES = ["a\n\n  b\t x  ", "  ", " ", "\n", "\r\n", "x\r\ny\r", "x\r", "</s><s> [INST] <|endoftext|> <unk>", "▁ marked", "a▁b", "<0x41> \x00 \x1c", "it's we'll DON'T",
         "中文字 \U0001F600\U0001F468‍\U0001F469 é", "\xa0a\xa0 b　c   d\x85e", "a  \nb   c \n\n\n d", "\ttab\t\ttab \t x\n\ty", "ﬁ ½ ǆ Å", "x" * 3000, "12345678901234567890 3.14"]


def test_matches_plain_library_calls(spark):
    rows = [(i, t if t is None or len(t) < 50_000 else t[:20_000]) for i, t in edge_rows()] + [(100 + k, t) for k, t in enumerate(CASES)]
    want = brute(rows)
    for more in ({}, {"shard": 50}):
        got = align.align(documents(spark, rows), A, B, PATTERN, **more)
        got = sorted((str(r.row.doc_id), r.row.text or "", *r[1:]) for r in got.collect())
        assert got == sorted((str(i), t or "", *w) for (i, t), w in zip(rows, want))


def test_digest_is_of_the_groups_and_long_texts_are_whole(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(1, prose(rng, 3000)), (2, ""), (3, "▁"), (4, "line\n" * 2000 + prose(rng, 100))]
    want = brute(rows)
    got = {r.doc_id: r for r in align.align(documents(spark, rows), A, B, PATTERN, keep=["doc_id"], digest=True).select("row.doc_id", "*").collect()}
    for (i, _), w in zip(rows, want):
        assert got[i].groups == (sha(w[6]) if w[0] else "") and (got[i].n_a, got[i].n_links) == (w[0], w[3])
    # In parts of a few chunks, as a text of many megabytes is.
    monkeypatch.setattr(align, "PART", 7)
    assert [x[4] for x in align.aligner(A, B, PATTERN).align_all([t for _, t in rows], False)] == [w[6] for w in want]
    own = align.aligner(A, B, PATTERN)
    for (_, t), w in zip(rows, want):
        na, nb, ng, nl, groups, pairs, times = own.align_all([t], False)[0]
        assert (na, nb, ng, nl, groups) == (*w[:4], w[6]) and times.sum() == w[3] and len(set(pairs.tolist())) == len(pairs)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\r\t.,'ab1\xa0　▁é"), st.characters(blacklist_categories=["Cs"])), max_size=40))
def test_chunks_join_to_the_whole_text(text):
    got = align.aligner(A, B, PATTERN).align_all([text], False)[0]
    na, nb, groups, links = brute_one(text)
    assert (got[0], got[1], got[2], got[3], got[4]) == (na, nb, len(groups), len(links), ";".join(groups))
    assert Counter(dict(zip(got[5].tolist(), got[6].tolist()))) == Counter(b << 32 | a for a, b in links)


def test_memory_forgets_by_generations():
    made = []
    memory = align.Recent(lambda keys: [made.append(k) or k * 2 for k in keys], limit=3)
    assert memory.values([1, 2, 1]) == [2, 4, 2] and memory.values([3, 4]) == [6, 8]
    assert memory.values([1, 5]) == [2, 10] and made.count(1) == 1     # found in the older generation
    memory.values([6, 7, 8])
    memory.values([9, 10, 11, 12])
    assert memory.values([2]) == [4] and made.count(2) == 2            # forgotten, made again
    assert len(memory.young) + len(memory.old) < 12


def test_known_chunks_take_one_look_up_each(monkeypatch):
    own, text = align.Aligner(A, B, PATTERN), prose(random.Random(8), 500)
    want = own.align_all([text], False)[0][:5]
    looked, values = [], align.Recent.values
    monkeypatch.setattr(align.Recent, "values", lambda self, keys: looked.extend(keys) or values(self, keys))
    assert own.align_all([text], False)[0][:5] == want
    assert looked == align.CHUNK.findall(" " + text)


def test_new_chunks_are_encoded_together(monkeypatch):
    """A few encoder calls for many new words; chunks that can't be joined, or whose bytes differ, are found among them."""
    rng, calls = random.Random(9), []
    own = align.Aligner(A, B, PATTERN)

    class Counting:
        def __init__(self, whole):
            self.whole = whole

        def encode(self, x, **more):
            calls.extend([x] if isinstance(x, str) else x)
            return self.whole.encode(x, **more)

    own.b = Counting(own.b)
    text = prose(rng, 3000)
    assert own.align_all([text], False)[0][:5] == (*(w := brute_one(text))[:2], len(w[2]), len(w[3]), ";".join(w[2])) and len(calls) <= 4
    for together in (1, 3, 2048):
        monkeypatch.setattr(align, "TOGETHER", together)
        own, texts = align.Aligner(A, B, PATTERN), [prose(rng, 30), *CASES, prose(rng, 30)]
        for got, t in zip(own.align_all(texts, False), texts):
            na, nb, groups, links = brute_one(t)
            assert got[:5] == (na, nb, len(groups), len(links), ";".join(groups))
            assert Counter(dict(zip(got[5].tolist(), got[6].tolist()))) == Counter(b << 32 | a for a, b in links)


def test_empty_table(spark):
    assert align.align(documents(spark, []), A, B, PATTERN).count() == 0
