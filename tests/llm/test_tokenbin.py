import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from helpers import documents, edge_rows
from tillroll.llm import chunks, tokenbin
from tillroll.llm.common import RunFolder

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 16384, 16385, 50001])
def test_chunk_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2 ** 32 if n % 2 else 49408, n).astype("<u4")
    chunk = tokenbin.pack(ids, planes)
    assert np.array_equal(tokenbin.unpack(chunk), ids)
    with pytest.raises(ValueError):
        tokenbin.unpack(b"XXXX" + chunk[4:])


def test_planes_are_smaller_than_plain_ids():
    ids = np.random.default_rng(0).zipf(1.5, 100_000).clip(0, 49_000).astype("<u4")
    assert len(tokenbin.pack(ids)) < ids.nbytes / 2.5


@pytest.mark.parametrize("planes,chunk_ids", [("byte", 500), ("bit", 1 << 17)])
def test_files_hold_all_ids_in_order(spark, planes, chunk_ids):
    rows = edge_rows()
    own = Tokenizer.from_file(PATH)
    chunks, index = tokenbin.write_tokens(documents(spark, rows), RunFolder(spark, "test"), PATH, 2, planes=planes, chunk_ids=chunk_ids)
    got = sorted(tokenbin.read_tokens(chunks, index).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(own.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in want[r.doc_id]
        want[r.doc_id].remove(ids)
        at += len(ids)
    # The index finds the chunks of a range.
    some = got[len(got) // 2]
    part = tokenbin.read_tokens(chunks, index, some.start, some.start + 1).collect()
    assert any(r.start == some.start and r.ids == some.ids for r in part) and (planes == "bit" or len(part) < len(got))


def hard_texts():
    rng = random.Random(4)
    blanks = [" ", "  ", "\n", "\t\n ", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "\u200b", ""]
    bits = ["don't", "I'LL", "x's", "'", "''s", "12345", "¼²", "!!!", "<|endoftext|>", "é", "e\u0301", "É", "ΣΑΣ", "İx", "漢字かな", "\U0001F600", "\x00", "\ufeff", "thethe", "µªº", "×÷", "\u212b", "ﬁ"]
    texts = ["".join(rng.choice(blanks) + rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return texts + ["".join(chr(c) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 500)]


def test_words_equal_the_library_on_hard_texts():
    own = Tokenizer.from_file(PATH)
    texts = hard_texts()
    tokenbin.words.cache_clear()
    for text, got in zip(texts, tokenbin.words(PATH).encode_all([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_with_full_memory_and_long_texts(monkeypatch):
    monkeypatch.setattr(chunks, "LONG", 100)
    monkeypatch.setattr(chunks, "PART", 17)
    monkeypatch.setattr(chunks, "REMEMBER", 20)
    monkeypatch.setattr(tokenbin, "REMEMBER", 20)
    tokenbin.words.cache_clear()
    own = Tokenizer.from_file(PATH)
    text = edge_rows()[12][1] + " ΣΑΣ É é\u3000x \u0301y <|endoftext|> İ"
    tokenbin.words.cache_clear()
    assert np.frombuffer(tokenbin.words(PATH).encode_all([b"", text.encode(), b"a b"])[1], "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert tokenbin.token_table(spark, documents(spark, []), PATH, 2).count() == 0


def test_strings_of_added_tokens_are_encoded_as_the_plain_call_does(spark):
    own = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", "<|startoftext|>", "<|ENDOFTEXT|> z", "a<|endoftext|>b <| |>", "<|endoftext", "no < such > é<|endoftext|>中"]
    got = tokenbin.words(PATH).encode_all([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t
    assert 49407 in np.frombuffer(got[0], "<u4")
