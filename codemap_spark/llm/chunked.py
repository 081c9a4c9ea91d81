"""Exact memoised encoding of texts, space by space.

A byte-level pre-tokenizer with the usual pattern lets only a word's own single
space into its piece, so a text falls apart at single spaces: the encoding of
``a b`` is that of ``a`` followed by that of `` b``. That holds unless a space
has white space on both sides, which can share its piece, a space ends the text, or
a special token occurs in it; such texts are encoded as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

#: Chunks remembered in a worker; then the memory starts afresh. Longer ones are not remembered.
MEMO, LONGEST = 1_300_000, 48
#: White space on both sides of a space, which is looked for only where any stands before one: a search for two characters is fast.
TOUCHING = re.compile(r"\s \s")
BEFORE = tuple(chr(c) + " " for c in range(0x3001) if chr(c).isspace() and chr(c) != " ")
#: Signs that make a piece of their own after a Latin word; an apostrophe may begin a contraction and is none.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Runs of signs, and words after a line end, that are remembered beside the chunks.
PARTS = 100_000


class _Memo(dict):
    def __init__(self, encode: Callable[[str], list[int]], most: int):
        super().__init__()
        self.encode, self.most = encode, most
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        """The ids of signs, or of a line end and what follows it."""
        if text not in self.parts:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[text] = array("I", self.encode(text)).tobytes()
        return self.parts[text]

    def __missing__(self, chunk: str) -> bytes:
        # A single line end is a piece of its own, and so are a Latin word and the signs after it: all are reused.
        line, end, rest = chunk.partition("\n")
        core = chunk.rstrip(SIGNS)
        if end and line and rest and not line[-1].isspace() and not rest[0].isspace():
            return self[line] + self.part("\n" + rest)  # seldom seen again as a whole
        if len(core) < len(chunk) and core.isalpha() and max(core) < "\u0250":
            ids = self[core] + self.part(chunk[len(core) :])
            if len(chunk) - len(core) > 1:
                return ids
        else:
            ids = array("I", self.encode(" " + chunk)).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkedEncoder:
    """encode: exact ids of any text without special tokens; whole: of any text."""

    def __init__(self, encode: Callable[[str], list[int]], whole: Callable[[str], list[int]], specials: list[str], memo: int | None = None):
        self.encode, self.whole, self.specials = encode, whole, specials
        self.memo = _Memo(encode, MEMO if memo is None else memo)

    def ids(self, text: str) -> bytes:
        """The ids as native unsigned 32-bit integers."""
        if not text:
            return b""
        if text[-1] == " " or "  " in text or (any(w in text for w in BEFORE) and TOUCHING.search(text)) or any(s in text for s in self.specials):
            return array("I", self.whole(text)).tobytes()
        first, _, rest = text.partition(" ")
        head = array("I", self.encode(first)).tobytes() if first else b""
        return head + b"".join(map(self.memo.__getitem__, rest.split(" "))) if _ else head
