"""Encoding of texts piece by piece with a BPE model of the tokenizers library.

A text of Latin-1 characters is split into pieces by the vocabulary's split pattern, written out for Latin-1, and each distinct
piece goes to the library's BPE model once.  Any other text is cut in chunks, runs of non-blanks with the blanks before
them where they count: no match of the split patterns used here reaches over the end of a chunk, so a text's ids are its chunks' ids, and each
distinct chunk goes through the library's whole encoder once.  What is remembered is bounded.
"""
from __future__ import annotations

import re
from array import array
from itertools import islice

#: Distinct pieces, and chunks, that a worker remembers; when full, it keeps those of the present slice.
REMEMBER = 1 << 17
#: A text of this many bytes or more is encoded in parts of ``PART`` pieces.
LONG, PART = 4 << 20, 100_000
#: Blanks as the library's patterns understand them (Unicode White_Space), for a character class.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers of Latin-1, for a character class.
LETTER, LOWER, NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: its own where it has one, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_CHARS = dict(enumerate(byte_chars()))


class Memory:
    """Ids of distinct strings, made by ``make`` and remembered (``limit``: how many, ``REMEMBER`` if None)."""

    def __init__(self, make, limit: int | None = None):
        self.make, self.known, self.limit = make, {}, limit

    def learn(self, used: set[str]) -> None:
        new = {x for x in used if x not in self.known}
        if len(self.known) + len(new) > (self.limit or REMEMBER):
            self.known = {x: self.known[x] for x in used - new}
        known, make = self.known, self.make
        for x in new:
            known[x] = make(x)

    def joined(self, parts: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, parts))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """``tokenizer``: of the library; ``chunk`` and ``split``: patterns of chunks and, for Latin-1, of pieces; ``fold``: lower case first; ``limit``: of the pieces' memory."""

    def __init__(self, tokenizer, chunk: re.Pattern, split: re.Pattern, fold: bool = False, limit: int | None = None):
        self.tokenizer, self.model, self.chunk, self.split, self.fold = tokenizer, tokenizer.model, chunk, split, fold
        self.pieces, self.chunks = Memory(self._piece, limit), Memory(self._chunk)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode("utf-8").decode("latin-1").translate(_CHARS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _way(self, text: str) -> tuple[Memory, re.Pattern, str]:
        if _is_latin(text):
            return self.pieces, self.split, text.lower() if self.fold else text
        return self.chunks, self.chunk, text

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text as native unsigned 32-bit integers."""
        parts, used = [], {id(self.pieces): set(), id(self.chunks): set()}
        for text in texts:
            memory, pattern, text_ = self._way(text.decode("utf-8"))
            if len(text) < LONG:
                own = pattern.findall(text_)
                used[id(memory)].update(own)
                parts.append((memory, own))
            else:
                parts.append((None, (memory, pattern, text_)))
        for memory in (self.pieces, self.chunks):
            memory.learn(used[id(memory)])
        out = [memory.joined(own) if memory else None for memory, own in parts]
        return [x if x is not None else self._long(*parts[k][1]) for k, x in enumerate(out)]

    def _long(self, memory: Memory, pattern: re.Pattern, text: str) -> bytes:
        found, out = pattern.finditer(text), []
        while some := [m[0] for m in islice(found, PART)]:
            memory.learn(set(some))
            out.append(memory.joined(some))
        return b"".join(out)
