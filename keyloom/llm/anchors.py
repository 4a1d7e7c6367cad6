"""Anchors of fixed-length windows of bytes, and prefix hashes of bytes, in numpy.

Every window of ``length`` bytes has one anchor: of the ``GRAM``-byte strings in it, the
first with the least hash. It depends on the window's bytes alone, so equal windows have
equal anchors at equal places. Neighbouring windows mostly share theirs: a run is a
maximal range of windows with the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np

from .hashing import mix, powers

GRAM = 32
#: Bytes of text that are hashed at once (a longer text is one block).
BLOCK_BYTES = 1 << 20

_VALUE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of every prefix, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``lo`` to ``hi``, wherever they stand."""
    _, down = powers(len(sums))
    return (sums[hi] - sums[lo]) * down[lo]


def blocks(raw: Sequence[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, b in enumerate(raw):
        held.append(b)
        size += len(b)
        if size >= BLOCK_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Runs:
    """Runs of a block of texts. Arrays: text, lo and hi (first and last window start within
    the text), left (bytes from lo to the anchor) and gram (hash of the anchor)."""

    def __init__(self, held: list[bytes], length: int):
        raw = b"".join(held)
        data = np.frombuffer(raw, np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(b) for b in held]))).astype(np.int64)
        n, across = len(data), length - GRAM + 1
        if n < length:
            self.text = self.lo = self.hi = self.left = np.empty(0, np.int64)
            self.gram, self._raw, self._at, self._end = np.empty(0, np.uint64), b"", self.lo, self.lo
            return
        sums = prefix_sums(data)
        _, down = powers(n + 1)
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        bits = np.uint64(32)  # the same in every block, so that equal windows choose alike
        key = gram >> bits << bits | np.arange(len(gram), dtype=np.uint64)
        rows = -(-len(key) // across)
        square = np.full(rows * across, np.iinfo(np.uint64).max)
        square[: len(key)] = key
        square = square.reshape(rows, across)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        least = np.minimum(back[:starts], ahead[across - 1 : across - 1 + starts])
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # Windows that lie within one text.
        inside = np.zeros(starts + 1, np.int8)
        has = np.diff(begin) >= length
        np.add.at(inside, begin[:-1][has], 1)
        np.add.at(inside, begin[1:][has] - length + 1, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        at = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.append((anchor[1:] != anchor[:-1]) | ~inside[1:], True))
        self.text = np.searchsorted(begin, at, "right") - 1
        off = begin[self.text]
        self.lo, self.hi, self.left = at - off, stop - off, anchor[at] - at
        self.gram = gram[anchor[at]]
        self._raw, self._at, self._end = raw, at, stop + length

    def digests(self) -> np.ndarray:
        """Two longs for each run: a cryptographic digest of its bytes. No two strings of
        the same digest are known."""
        raw = memoryview(self._raw)
        found = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self._at.tolist(), self._end.tolist())]
        return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
