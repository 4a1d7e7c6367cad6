"""Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

The library's split never lets a token hold a space that stands after a character that is
no white space, other than as its first byte, so a text may be cut there and each chunk be
encoded, and remembered, alone. Chunks of plain Latin script are merged by tiktoken's core
from the same vocabulary (its split and the library's agree on those characters); anything
else, and texts that spell an added token, go to the library itself.
"""

from __future__ import annotations

import json
import re
from array import array

#: Chunks kept in a Python worker before its store starts anew.
STORE_CHUNKS = 500_000

#: The split of byte-level BPE (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ƺ]*")
_CUT = re.compile(r"(?<=\S)(?= )")
_LAST_PLAIN = "ƺ"


class LooseSpace(Exception):
    """A chunk ends in white space, so the text must be cut with more care."""


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE back to bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids, as unsigned 32-bit bytes, of a chunk that ``lead`` (a space or nothing) precedes."""

    def __init__(self, owner, lead: str):
        self.owner, self.lead, self.byte_lead = owner, lead, lead.encode()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and max(chunk) <= _LAST_PLAIN:
            out = array("I", self.owner.piece(self.byte_lead + chunk.encode())).tobytes()
        elif not chunk or chunk[-1].isspace():
            raise LooseSpace
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # letters and marks never share a token
            out = self[chunk[:-1]] + self.owner.bare[chunk[-1]]
        elif "\n" in chunk:
            head, *rest = chunk.split("\n")
            if not head or any(not x or x[0].isspace() for x in rest):
                return self.owner.encode(self.lead + chunk)
            newline, bare = self.owner.newline, self.owner.bare
            return self[head] + b"".join(newline + bare[x] for x in rest)
        else:
            out = self.owner.encode(self.lead + chunk)
        if len(self) >= STORE_CHUNKS:
            self.clear()
        self[chunk] = out
        return out


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec["added_tokens"]]
        at, added = _byte_of(), set(self.added)
        ranks = {bytes(at[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self._core = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.piece = self._core._core_bpe.encode_single_piece
        self.chunks, self.bare = _Chunks(self, " "), _Chunks(self, "")
        self.newline = self.encode("\n")

    def encode(self, s: str) -> bytes:
        """Ids of a whole string."""
        if _PLAIN.fullmatch(s):
            ids = self._core.encode_ordinary(s)
        else:
            ids = self.library.encode(s, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.encode_by_library(text)
        first, *rest = text.split(" ")
        try:
            return b"".join([self.bare[first] if first else b"", *map(self.chunks.__getitem__, rest)])
        except LooseSpace:
            return b"".join(map(self.encode, _CUT.split(text)))

    def encode_by_library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


_open: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _open:
        _open[path] = ByteBpe(path)
    return _open[path]
