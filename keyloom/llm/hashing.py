"""Hashes of words and word shingles for many texts at once, in numpy.

Texts are lowered; a word is a run of ASCII letters, digits and underscores and of any
bytes beyond ASCII. A word's hash is a polynomial over its bytes modulo 2**64, taken from
prefix sums; a shingle's hash is a fixed mix of its words' hashes. Texts of one to four
words have a single shingle, made of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D  # an odd multiplier (fixed value)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = True
_VALUE[~_IS_WORD] = 0
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as lowered bytes), about BLOCK_BYTES at a time."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.lower().encode() if t else b""
        held.append(b)
        size += len(b)
        if size >= BLOCK_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _edges(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers, start and end of each word, first byte of each text)."""
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    begin = np.concatenate(([0], np.cumsum(np.array([len(b) + 1 for b in held], np.int64))))
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    edge = np.diff(_IS_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return sums, down, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), begin


def words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and the end)."""
    sums, down, start, end, begin = _edges(held)
    return mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, begin)


def words_and_prefixes(held: list[bytes], lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word and of its prefixes of so many bytes, the text of each)."""
    sums, down, start, end, begin = _edges(held)
    text = np.searchsorted(begin, start, "right") - 1
    hashes, owners = [mix((sums[end] - sums[start]) * down[start])], [text]
    for n in lengths:
        longer = end - start > n
        at = start[longer]
        hashes.append(mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)))
        owners.append(text[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, index of the first shingle of each text and the end)."""
    n = np.diff(at)
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    first = np.concatenate(([0], np.cumsum(per)))
    if not len(word):
        return np.empty(0, np.uint64), first
    padded = np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
    total = np.zeros(len(word), np.uint64)
    for k in range(SHINGLE):
        total += padded[k : k + len(word)] * _MIX[k]
    pick = np.repeat(at[:-1] - first[:-1], per) + np.arange(first[-1])
    out = total[pick]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        own = word[at[d] : at[d + 1]]
        out[first[d]] = np.sum(own * _MIX[: len(own)], dtype=np.uint64)
    return mix(out), first
