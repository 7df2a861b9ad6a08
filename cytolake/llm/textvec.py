"""Vectorised hashing of words and shingles over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
CHUNK = 1 << 20  # bytes hashed at a time; bounds the working arrays whatever a text's length
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random value per byte, and the multiplier's inverse modulo 2**64 (as a one-element array)."""
    return mix64(np.arange(1, 257, dtype=U) * U(_P)), np.array([pow(_P, -1, 1 << 64)], U)


@lru_cache(2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = int(_tables()[1][0]) if inverse else _P
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _chunk_words(data: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one chunk: differences of a running polynomial, brought to the same power."""
    if fold_case:
        data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, (len(data) - 1).bit_length())
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_tables()[0][data] * _powers(size, False)[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * _powers(size, True)[start]), start


def word_hashes(texts: list[bytes], fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other than ASCII white space), and each text's first position among them.

    fold_case: A-Z count as a-z. The second array has one element more than texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data) and not _SPACE[data[stop - 1]]:  # to the next white space, found piece by piece
            ahead = np.flatnonzero(_SPACE[data[stop : stop + 4096]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(len(data), stop + 4096)
        h, s = _chunk_words(data[at:stop], fold_case)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes: width words in a row, or all words where there are fewer."""
    words, first = word_hashes(texts)
    q = [U(pow(_P, k + 1, 1 << 64)) for k in range(width)]
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), U)
    for k in range(width if n > 0 else 0):
        rolled += words[k : k + n] * q[k]
    rolled = mix64(rolled + U(width))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            out.append(mix64(np.add.reduce(words[a:b] * np.array(q[: b - a], U), keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
