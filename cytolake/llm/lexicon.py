"""A minimal acyclic transducer over byte strings, kept as flat arrays that are mapped from a file.

Words share beginnings and endings. Each edge carries the number of words that come before those behind it, so that the
sum along a word's path is the word's rank, and the rank points to the word's ids.
"""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np

_ARRAYS = (("keys", "<i8"), ("targets", "<i4"), ("adds", "<i4"), ("finals", "<u1"), ("offsets", "<i4"), ("ids", "<i4"))


def compile_words(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton's file: built from sorted words, each new word closing the states that no later word can share."""
    words = sorted(entries)
    edges: list[dict[int, int]] = [{}]  # state -> label -> state
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]  # the states along the last word
    last = b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            same = register.setdefault((final[state], tuple(edges[state].items())), state)
            edges[path[-1]][last[len(path) - 1]] = same

    for word in words:
        k = len(os.path.commonprefix([word, last]))
        close(k)
        for label in word[k:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][label] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    close(0)

    order, number = [], {}  # states that are reached, children before parents
    stack = [(0, False)]
    while stack:
        state, left = stack.pop()
        if left:
            number[state] = len(order)
            order.append(state)
        elif state not in number:
            number[state] = -1
            stack.append((state, True))
            stack += [(t, False) for t in edges[state].values() if t not in number]
    n = len(order)
    below = np.zeros(n, np.int64)
    keys, targets, adds = [], [], []
    for i, state in enumerate(order):
        run = int(final[state])
        for label, target in sorted(edges[state].items()):
            # the root gets number 0 in the file
            keys.append(((n - 1 - i) << 8) | label)
            targets.append(n - 1 - number[target])
            adds.append(run)
            run += below[number[target]]
        below[i] = run
    by_key = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [entries[w] for w in words]
    arrays = {
        "keys": np.array(keys, np.int64)[by_key],
        "targets": np.array(targets, np.int32)[by_key],
        "adds": np.array(adds, np.int32)[by_key],
        "finals": np.array([final[s] for s in reversed(order)], np.uint8),
        "offsets": np.cumsum([0, *map(len, ids)]),
        "ids": np.array([x for t in ids for x in t]),
    }
    body = [arrays[name].astype(kind).tobytes() for name, kind in _ARRAYS]
    return struct.pack("<6q", *map(len, body)) + b"".join(b + b"\0" * (-len(b) % 8) for b in body)


class Lexicon:
    """Looks words up in a compiled automaton, many at a time."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        sizes = struct.unpack("<6q", raw[:48].tobytes())
        at = 48
        for (name, kind), size in zip(_ARRAYS, sizes, strict=True):
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    @classmethod
    def mapped(cls, data: bytes) -> "Lexicon":
        """Map the automaton from a file of this machine; the file loses its name at once and goes with the mapping."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(f.name)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank among the compiled ones, or -1."""
        return self.ranks_flat(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def ranks_flat(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same for words whose bytes stand one behind the other."""
        out = np.full(len(lengths), -1, np.int64)
        if not len(self.keys) or not len(lengths):
            return out
        begin = np.cumsum(lengths) - lengths
        rows = np.arange(len(lengths))
        state, rank = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        step = 0
        while len(rows):
            ended = lengths[rows] == step
            if ended.any():
                done = rows[ended]
                out[done] = np.where(self.finals[state[done]] == 1, rank[done], -1)
                rows = rows[~ended]
            key = (state[rows] << 8) | data[begin[rows] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            rows, edge = rows[found], edge[found]
            rank[rows] += self.adds[edge]
            state[rows] = self.targets[edge]
            step += 1
        return out

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
