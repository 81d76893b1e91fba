import random

import public_tokenizers as P
import pytest
from pyspark.sql import types as T

from helpers import prose, sha
from tillroll.llm import bpe, chat

RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("window", "p", "seg", "part", "nk", "new")]])
HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<", "[", "</s", "[/INST", "<s></s>[INST]\\[/INST]", "", "a\n\nb", "\U0001F600é"]


def conversations():
    rng, rows = random.Random(3), []
    for c in range(12):
        if c % 3:
            rows.append((c, 0, "system", prose(rng, rng.randint(1, 30))))
        for t in range(1, rng.randint(2, 25)):
            rows.append((c, t, "user" if t % 2 else "assistant", prose(rng, rng.randint(0, 80))))
    rows += [(100, k, r, t) for k, (r, t) in enumerate((r, t) for t in HARD for r in ("user", "assistant"))]
    rows += [(101, 0, "system", "only a system turn"), (102, 0, "assistant", prose(rng, 900)), (102, 1, "user", "x"), (103, 0, "user", None), (103, 1, None, "no role"), (103, None, "assistant", "no turn"),
             (None, 1, "assistant", "no id"), (None, 0, "user", "hello"), (104, 0, "user", "twice"), (104, 0, "user", "twice"), (104, 0, "assistant", "tie"), (105, 3, "</s>", "odd\\ role"),
             (106, 0, "system", prose(rng, 300)), (106, 1, "user", "q"), (106, 2, "assistant", "a")]
    return rows


def turns_of(rows, conv):
    own = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
    return sorted(own, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.fixture(scope="module")
def windows(spark):
    frame = spark.createDataFrame([(*r, *"abcdef") for r in conversations()], SCHEMA)
    return chat.format_windows(frame, RANKS, P.PATTERN, budget=256, history=64)


def test_digests_read_back_from_the_output(windows):
    rows = conversations()
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    assert set(got) == {c for c, *_ in rows}
    for conv, r in got.items():
        turns = turns_of(rows, conv)
        assert r.n_turns == len(turns)
        if conv not in (104,):  # its tie is ordered by content, checked below
            loss = "".join(x for _, role, x in turns if role == "assistant")
            assert (r.turns_sha256, r.loss_chars, r.loss_sha256) == (sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(loss), sha(loss)), conv
    assert got[104].loss_chars == 3


def test_windows_hold_the_budget_and_the_rules(windows):
    rows, own = conversations(), bpe.Codec(RANKS, P.PATTERN)
    by = {}
    for w in windows.collect():
        by.setdefault(w.conv_id, []).append(w)
    over = 0
    for conv, ws in by.items():
        ws.sort(key=lambda w: w.window)
        turns = turns_of(rows, conv)
        system = turns[0][1] == "system"
        at = 0
        for k, w in enumerate(ws):
            read = chat.read_turns(w.text)
            new, old = read[w.n_repeated:], read[:w.n_repeated]
            if conv != 104:
                assert new == [(a, x) for _, a, x in turns[at:at + len(new)]]
                if k:
                    if system:
                        assert old[0] == turns[0][1:]
                    history = old[system:]
                    assert history == [(a, x) for _, a, x in turns[at - len(history):at]] and (not history or at - len(history) >= system)
                else:
                    assert not old
            at += len(new)
            sizes = [len(own.encode(s.encode())) for s in split(w.text)]
            assert w.n_tokens == sum(sizes)
            assert sum(sizes[system if k else 0:w.n_repeated]) <= 64
            if w.n_tokens > 256:
                over += 1
                assert len(new) == 1 or (k == 0 and system and len(new) == 2)
        assert at == len(turns)
    assert over


def split(text):
    return [x + "</s>" for x in text.split("</s>")[:-1]]


def test_escapes_undo_themselves(spark):
    frame = spark.createDataFrame([(t,) for t in HARD], "t string")
    for r in frame.select("t", chat.escaped(frame.t).alias("e")).collect():
        assert chat.unescaped(r.e) == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_empty_table(spark):
    none = chat.format_windows(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN)
    assert none.count() == 0 and chat.conversation_digests(none).count() == 0
