import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from helpers import documents, edge_rows, prose, sha
from tillroll.llm import bpe, chunks

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_rank_library_on_hard_texts(reference):
    own = bpe.Codec(RANKS, P.PATTERN)
    rng = random.Random(4)
    blanks = [" ", "  ", "\n", "\t\n ", "\x85", "\xa0", " ", "　", "\x1c", "​", ""]
    bits = ["don't", "I'LL", "x's", "'", "''s", "12345", "¼²", "!!!", "<|endoftext|>", "é", "é", "漢字かな", "\U0001F600", "\x00", "﻿", "thethe"]
    texts = ["".join(rng.choice(blanks) + rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(c) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 500)]
    for t in texts:
        ids = own.encode(t.encode())
        assert ids.tolist() == reference.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


def test_very_long_text_and_full_memory(reference, monkeypatch):
    monkeypatch.setattr(chunks, "LONG", 1000)
    monkeypatch.setattr(chunks, "PART", 77)
    monkeypatch.setattr(chunks, "REMEMBER", 50)
    own, t = bpe.Codec(RANKS, P.PATTERN), prose(random.Random(1), 3000)
    assert own.encode(t.encode()).tolist() == reference.encode_ordinary(t)


def test_offsets_give_split_characters_whole():
    own = bpe.Codec(RANKS, P.PATTERN)
    t = "aé漢\U0001F600 z"
    ids = own.encode(t.encode())
    start, end = own.char_offsets(ids, t.encode())
    pos = np.cumsum([0, *(len(own.decode(ids[k:k + 1])) for k in range(len(ids)))])
    char_at = [k for k, c in enumerate(t) for _ in c.encode()]
    for k in range(len(ids)):
        assert (start[k], end[k]) == (char_at[pos[k]], char_at[pos[k + 1] - 1] + 1)
    assert any(start[k + 1] < end[k] for k in range(len(ids) - 1))


def test_round_trip_over_edge_rows(spark, reference):
    docs = documents(spark, edge_rows())
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, offsets=True), RANKS, P.PATTERN).collect()
    assert len(out) == len(edge_rows())
    for r in out:
        t = r.row.text or ""
        assert r.ids == reference.encode_ordinary(t) and sha(bytes(r.decoded)) == sha(t) and r.row["ids"] == "ids!"
    empty = documents(spark, [])
    assert bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
