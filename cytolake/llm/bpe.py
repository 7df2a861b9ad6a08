"""BPE encoding and decoding: frequent words from a memory-mapped transducer, unseen words by exact merging.

Texts fall apart at white space, and no token reaches across it. Whole slices of texts are cut into words at once, on
arrays of code points; pieces with characters that normalising or the pattern treats specially are cut one by one. A
word's ids come from the lexicon of the corpus's frequent words, or else from merging its symbols by rank, many words
together. Lexicon and memories decide the speed only, never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, most_frequent, read_table, tidy
from .lexicon import Lexicon, compile_words

MAX_SLICE = 3 << 20
#: Characters that are cut into words at a time; bounds the working arrays whatever a text's length.
CHUNK = 1 << 19
#: Words compiled into the lexicon, at most; all others are merged.
LEXICON_WORDS = 65_536
#: Merged words that a worker remembers, and distinct words that a task counts before it passes them on.
MEMORY, COUNTED = 150_000, 500_000
#: Code points below this may be cut by arrays, where simple_classes() knows them; words of more symbols are merged alone.
SIMPLE, LONG = 0x530, 48
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
#: White space in Unicode, without the four separators U+001C to U+001F that Python adds to it.
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")

#: Code points that are letters or numbers in later editions of Unicode than the tokenizer's pattern knows.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Lower case that Python does not know yet, as first and last code point and the first one's lower case.
LATER_LOWER = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
_LATER = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER) + "]"
_HAS_LATER = regex.compile(_LATER)
#: Lower case is by character, so that a sigma never becomes a final one.
_LOWER = {c: low + c - a for a, b, low in LATER_LOWER for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


NO_RANK = 1 << 30


class Vocabulary:
    """What a tokenizer file of this kind (BPE with word ends, byte-level alphabet, no decoder) says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.outer = [vocab[s + self.suffix] for s in symbols]
        self.merged_ids = np.zeros(len(pairs) + 1, np.int32)
        for rank, new in self.merges.values():
            self.merged_ids[rank] = new
        self.inner_ids, self.outer_ids = np.array(self.inner, np.int32), np.array(self.outer, np.int32)
        self._hash_pairs()
        both = [self.ranks(np.repeat(self.inner_ids, 256), np.tile(second, 256)) for second in (self.inner_ids, self.outer_ids)]
        self.first_ranks = np.stack(both).reshape(2, 256, 256)  # of pairs of bytes: within a word, at its end
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.digest = hashlib.sha256(json.dumps([spec["added_tokens"], model["vocab"], pairs, self.pattern, self.suffix]).encode()).hexdigest()

    def _hash_pairs(self) -> None:
        """The pairs in an open hash table: slots of keys and ranks, a free slot ends a search."""
        keys = np.array([a << 20 | b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int32)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slots, self.slot_ranks = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.slots[at[rest]] < 0
            self.slots[at[rest[free]]] = keys[rest[free]]  # of several for a slot the last one has it
            won = self.slots[at[rest]] == keys[rest]
            self.slot_ranks[at[rest[won]]] = ranks[rest[won]]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK for pairs that do not merge."""
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.slot_ranks[at], np.int32(NO_RANK))
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.slots)
            found = self.slots[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.slot_ranks[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: at each step the pair of lowest rank, the leftmost of these, becomes one symbol."""
        return self._merged_long([self.inner[b] for b in word[:-1]] + [self.outer[word[-1]]])

    def merged_many(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words that are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, n = self.merged_flat(np.frombuffer(b"".join(words), np.uint8), lengths)
        end = np.cumsum(n)
        return [flat[z - k : z].tolist() for z, k in zip(end.tolist(), n.tolist(), strict=True)]

    def merged_flat(self, data: np.ndarray, lengths: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one behind the other, and how many each has; data holds the words' bytes likewise.

        All words of a block take a step together: each word's leftmost pair of lowest rank becomes one symbol."""
        begin = np.cumsum(lengths) - lengths
        counts = np.zeros(len(lengths), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (rows, their ids)
        short = np.flatnonzero(lengths <= LONG)
        short = short[np.argsort(lengths[short], kind="stable")]
        for at in range(0, len(short), block):
            parts += self._merged_block(data, begin, lengths, short[at : at + block], counts)
        for row in np.flatnonzero(lengths > LONG).tolist():
            ids = self.merged(data[begin[row] : begin[row] + lengths[row]].tobytes())
            counts[row] = len(ids)
            parts.append((np.array([row]), np.array(ids, np.int32)))
        out = np.zeros(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for rows, ids in parts:
            out[ragged(first[rows], counts[rows])] = ids
        return out, counts

    def _merged_block(self, data, begin, lengths, rows, counts) -> list[tuple[np.ndarray, np.ndarray]]:
        n = lengths[rows]
        raw = data[ragged(begin[rows], n)]
        start = np.cumsum(n) - n
        last = start + n - 1
        ids = self.inner_ids[raw]
        ids[last] = self.outer_ids[raw[last]]
        ranks = np.full(len(raw), NO_RANK, np.int32)
        ranks[:-1] = self.first_ranks[0][raw[:-1], raw[1:]]
        many = last[n > 1]
        ranks[many - 1] = self.first_ranks[1][raw[many - 1], raw[many]]
        ranks[last] = NO_RANK
        out = []
        while len(rows):
            best = np.minimum.reduceat(ranks, start)
            done = best == NO_RANK
            if done.any():
                over = np.repeat(done, n)
                counts[rows[done]] = n[done]
                out.append((rows[done], ids[over]))
                going = ~done
                rows, n, best = rows[going], n[going], best[going]
                if not len(rows):
                    break
                ids, ranks = ids[~over], ranks[~over]
                start = np.cumsum(n) - n
            at = np.flatnonzero(ranks == np.repeat(best, n))
            if len(at) > len(rows):  # a word's lowest rank stands there more than once: the leftmost
                word = np.searchsorted(start, at, "right")
                at = at[np.concatenate(([True], word[1:] != word[:-1]))]
            ids[at] = self.merged_ids[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            closes = at + 1 == start + n - 1  # the pair ends its word
            opens = at == start
            ids, ranks = ids[keep], ranks[keep]
            n = n - 1
            start = np.cumsum(n) - n
            at = at - np.arange(len(at))
            ranks[at] = NO_RANK
            inside = at[~closes]
            ranks[inside] = self.ranks(ids[inside], ids[inside + 1])
            inside = at[~opens]
            ranks[inside - 1] = self.ranks(ids[inside - 1], ids[inside])
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for words of any length."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x, live in zip(ids, alive, strict=True) if live]


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n places each, one behind the other."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def strings(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def bytes_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, one behind the other, and their lengths."""
    words = pa.concat_arrays([words])  # from offset 0
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


@lru_cache(1)
def simple_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point.

    SPECIAL is whatever may compose with its neighbours, changes when normalised, has no single lower case, stands in
    the pattern's fixed words or in special tokens, or lies beyond SIMPLE."""
    classes, lower = np.full(0x110000, SPECIAL, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(SIMPLE):
        x = chr(c)
        low = x.translate(_LOWER).lower()
        if x in "'<" or 0x1C <= c < 0x20 or unicodedata.category(x)[0] == "M" or not unicodedata.is_normalized("NFC", x) or len(low) > 1 or _HAS_LATER.match(x):
            continue
        classes[c] = LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER
        lower[c] = ord(low)
    for c in range(0x3001):
        if _SPACES.match(chr(c)):
            classes[c] = SPACE
    return classes, lower


class Codec:
    """Encodes and decodes texts; remembers the words that it merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memory: int = MEMORY):
        self.v, self.lexicon, self.limit = vocabulary, lexicon, memory
        self.words = regex.compile(self.v.pattern)
        later = self.v.pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{_LATER})+").replace(r"[\p{L}]+", rf"(?:(?!{_LATER})\p{{L}})+").replace(r"[\p{N}]", rf"(?!{_LATER})\p{{N}}")
        self.later_words = regex.compile(later)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) or r"(?!)")
        most = max(self.v.tokens, default=0) + 1
        self.id_text = pa.array(map(str, range(most)), pa.string())
        self.token_text = pa.array([self.v.tokens.get(i, "") for i in range(most)], pa.string())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # merged word -> its number
        self.held, self.held_ids = 0, [np.zeros(0, np.int32)]
        self.known_first, self.known_n = np.zeros(self.limit, np.int64), np.zeros(self.limit, np.int64)

    # --- cutting texts into words

    def special_words(self, piece: str) -> list[str]:
        """The words of a piece between white space; special tokens are words of their own, as they are."""
        out, at = [], 0
        for m in self.special.finditer(piece) if "<" in piece else ():
            out += [*self._normalised_words(piece[at : m.start()]), m[0]]
            at = m.end()
        return out + self._normalised_words(piece[at:])

    def _normalised_words(self, piece: str) -> list[str]:
        """Composed, lower case character by character, split by the pattern."""
        if piece.isascii():
            return self.words.findall(piece.lower())
        piece = unicodedata.normalize("NFC", piece).translate(_LOWER).lower()
        return (self.later_words if _HAS_LATER.search(piece) else self.words).findall(piece)

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
        """What the texts fall into, by arrays: the distinct items; which of them are pieces still to be cut one by one;
        the texts' items in order, by number; and where each text's items begin (one more than texts)."""
        classes, lower = simple_classes()
        data = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
        kind = classes[data]
        apart = kind == SPACE
        low = lower[data]
        if (odd := np.flatnonzero(kind == SPECIAL)).size:
            piece = np.cumsum(apart)  # white space before: the same for all of a piece
            whole = np.zeros(int(piece[-1]) + 1, bool)
            whole[piece[odd]] = True
            inside = whole[piece] & ~apart
            kind[inside] = SPECIAL
            low[inside] = data[inside]
        first = ~apart
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start = np.flatnonzero(first)
        solid = low[~apart]
        place = np.flatnonzero(first[~apart])
        raw = solid.tobytes().decode("utf-32-le").encode()
        if len(raw) > len(solid):
            width = np.ones(len(solid), np.int64)
            for limit in (0x80, 0x800, 0x10000):
                width += solid >= limit
            place = (np.cumsum(width) - width)[place]
        coded = strings(raw, np.append(place, len(raw))).dictionary_encode()
        items, number = coded.dictionary, coded.indices.to_numpy()
        special = np.zeros(len(items), bool)
        special[number[kind[start] == SPECIAL]] = True
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return items, special, number, np.searchsorted(start, begin)

    # --- ids of words

    def word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one behind the other, and how many each has: from the lexicon, from memory, or by merging."""
        n = np.zeros(len(words), np.int64)
        data, lengths = bytes_of(words)
        rank = self.lexicon.ranks_flat(data, lengths) if self.lexicon else np.full(len(words), -1)
        seen, other = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        slot = self._learned(words.take(pa.array(other)))
        if len(seen):
            n[seen] = self.lexicon.offsets[rank[seen] + 1] - self.lexicon.offsets[rank[seen]]
        n[other] = self.known_n[slot]
        flat = np.zeros(int(n.sum()), np.int32)
        first = np.cumsum(n) - n
        if len(seen):
            flat[ragged(first[seen], n[seen])] = self.lexicon.ids[ragged(self.lexicon.offsets[rank[seen]].astype(np.int64), n[seen])]
        if len(other):
            flat[ragged(first[other], n[other])] = self.held_ids[0][ragged(self.known_first[slot], n[other])]
        return flat, n

    def _learned(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of distinct words in memory, after merging those that it lacks."""
        keys = words.cast(pa.binary()).to_pylist()
        if len(self.known) + len(keys) > self.limit:
            self.limit = max(self.limit, len(keys))
            self._forget()
        get = self.known.get
        slot = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            data, lengths = bytes_of(words.take(pa.array(new)))
            ids, n = self.v.merged_flat(data, lengths)
            at = len(self.known)
            slot[new] = np.arange(at, at + len(new))
            self.known.update(zip([keys[i] for i in new.tolist()], slot[new].tolist(), strict=True))
            self.known_n[slot[new]] = n
            self.known_first[slot[new]] = self.held + np.cumsum(n) - n
            if self.held + len(ids) > len(self.held_ids[0]):
                grown = np.zeros(2 * (self.held + len(ids)), np.int32)
                grown[: self.held] = self.held_ids[0][: self.held]
                self.held_ids[0] = grown
            self.held_ids[0][self.held : self.held + len(ids)] = ids
            self.held += len(ids)
        return slot

    def item_ids(self, items: pa.StringArray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of items, one behind the other, and how many each has."""
        pieces = np.flatnonzero(special)
        if not len(pieces):
            return self.word_ids(items)
        split = [self.special_words(p) for p in items.take(pa.array(pieces)).to_pylist()]
        plain = np.flatnonzero(~special)
        listed = [w for ws in split for w in ws]
        coded = pa.array([w for w in listed if w not in self.v.special], pa.string()).dictionary_encode()
        words = pa.concat_arrays([items.take(pa.array(plain)), coded.dictionary])
        words = words.dictionary_encode()
        flat, n = self.word_ids(words.dictionary)
        number = words.indices.to_numpy()
        reserved = sorted(self.v.special.values())
        flat, first = np.concatenate((flat, np.array(reserved, np.int32))), np.concatenate((np.cumsum(n) - n, len(flat) + np.arange(len(reserved))))
        n = np.concatenate((n, np.ones(len(reserved), np.int64)))
        own = iter(number[len(plain) :][coded.indices.to_numpy()].tolist())
        base = len(first) - len(reserved)
        parts = np.array([base + reserved.index(self.v.special[w]) if w in self.v.special else next(own) for w in listed], np.int64)
        size = np.ones(len(items), np.int64)
        size[pieces] = [len(ws) for ws in split]
        order = np.zeros(int(size.sum()), np.int64)
        begin = np.cumsum(size) - size
        order[begin[plain]] = number[: len(plain)]
        order[ragged(begin[pieces], size[pieces])] = parts
        total = np.zeros(len(items), np.int64)
        np.add.at(total, np.repeat(np.arange(len(items)), size), n[order])
        return flat[ragged(first[order], n[order])], total

    def chunks(self, texts: list[str]):
        """Lists of (row, part of its text): whole texts together, and long ones cut at white space."""
        held, size = [], 0
        for row, t in enumerate(texts):
            at = 0
            while at < len(t) or not at:
                end = len(t)
                if end - at > CHUNK:
                    m = _SPACES.search(t, at + CHUNK)
                    end = m.end() if m else end
                if held and size + end - at > CHUNK:
                    yield held
                    held, size = [], 0
                held.append((row, t[at:end]))
                size += end - at
                at = max(end, 1)
        if held:
            yield held

    def encoded(self, texts: list[str]):
        """For each chunk: rows, ids of all items and their numbers, items of each part."""
        for chunk in self.chunks(texts):
            items, special, number, begin = self.cut([t for _, t in chunk])
            flat, n = self.item_ids(items, special)
            yield [row for row, _ in chunk], flat, n, number, begin

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [r[3].tolist() for r in self.results(texts, digests=False)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does where a file names no decoder; unknown ids are left out."""
        tokens = self.v.tokens
        return " ".join(tokens[i] for i in ids if i in tokens)

    def results(self, texts: list[str], ids: bool = True, digests: bool = True) -> list[tuple[int, str, str, np.ndarray]]:
        """Of each text the number of ids, digests of the ids and of the decoded text, and the ids."""
        counts = [0] * len(texts)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts] if digests else []
        listed: list[list[np.ndarray]] = [[] for _ in texts]
        for rows, flat, n, number, begin in self.encoded(texts):
            keep = n[number] > 0
            begin = np.concatenate(([0], np.cumsum(keep)))[begin]
            number = number[keep]
            first = np.cumsum(n) - n
            total = np.concatenate(([0], np.cumsum(n[number])))[begin]
            if digests:
                offsets = pa.array(np.append(first, len(flat)).astype(np.int32))
                ends = pa.array(begin.astype(np.int32))
                for which, text in enumerate((self.id_text, self.token_text)):
                    words = pc.binary_join(pa.ListArray.from_arrays(offsets, text.take(pa.array(flat))), " ")
                    lines = pc.binary_join(pa.ListArray.from_arrays(ends, words.take(pa.array(number))), " ")
                    for row, line in zip(rows, lines.cast(pa.binary()).to_pylist(), strict=True):
                        if line:
                            hashes[row][which].update(b" " + line if counts[row] else line)
            if ids:
                every = flat[ragged(first[number], n[number])]
            for k, row in enumerate(rows):
                counts[row] += int(total[k + 1] - total[k])
                if ids:
                    listed[row].append(every[total[k] : total[k + 1]])
        none = np.zeros(0, np.int32)
        return [(counts[i], *([h.hexdigest() for h in hashes[i]] if digests else ("", "")), np.concatenate([none, *listed[i]])) for i in range(len(texts))]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def frequent_words(docs: DataFrame, vocabulary, limit: int) -> list[str]:
    """The most frequent words of all texts after normalising, in order of the words; limit bounds their number."""

    def run(batches):
        codec = Codec(vocabulary.value)
        held: list[pa.Table] = []

        def counted():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                for chunk in codec.chunks([t or "" for t in part.column("text").to_pylist()]):
                    items, special, number, _ = codec.cut([t for _, t in chunk])
                    n = np.bincount(number, minlength=len(items))
                    held.append(pa.table({"word": items.filter(pa.array(~special)), "n": pa.array(n[~special])}))
                    if special.any():
                        split = [codec.special_words(p) for p in items.filter(pa.array(special)).to_pylist()]
                        times = np.repeat(n[special], [len(ws) for ws in split])
                        held.append(pa.table({"word": pa.array([w for ws in split for w in ws], pa.string()), "n": pa.array(times)}))
                    if sum(len(t) for t in held) > 2 * COUNTED:
                        held = [counted()]
                        if len(held[0]) > COUNTED:
                            yield from held[0].to_batches()
                            held = []
        if held:
            yield from counted().to_batches()

    words = docs.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r.word for r in most_frequent(words, limit, "bpe-words").select("word").collect())


class Shared:
    """Vocabulary and compiled lexicon, broadcast once; workers map the lexicon from their own disk."""

    def __init__(self, docs: DataFrame, path: str | None, words: int):
        vocabulary = Vocabulary(path or default_path())
        context = docs.sparkSession.sparkContext
        self.vocabulary = context.broadcast(vocabulary)
        listed = [w.encode() for w in frequent_words(docs, self.vocabulary, words) if w and w not in vocabulary.special]
        self.lexicon = context.broadcast(compile_words(dict(zip(listed, map(tuple, vocabulary.merged_many(listed)), strict=True))))

    def codec(self) -> Codec:
        return Codec(self.vocabulary.value, Lexicon.mapped(self.lexicon.value))


def encode_documents(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids for every row of docs.

    Null and empty texts have no ids and decode to the empty text. Texts are encoded each by itself, so that repeated rows
    have the same result; long ones in parts that end at white space. An empty table gives no rows, and columns besides
    doc_id and text are not read. path: the tokenizer's file."""
    shared = Shared(docs, path, words)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        codec = shared_codec(shared)
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n, ids, decoded, every = zip(*codec.results(texts, with_ids), strict=True)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(every), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), out)


_codecs: dict[tuple[str, int], Codec] = {}


def shared_codec(shared: Shared) -> Codec:
    """One codec per worker process, vocabulary and lexicon, kept from task to task."""
    key = shared.vocabulary.value.digest, hash(shared.lexicon.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = shared.codec()
    return _codecs[key]


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), with_ids=False)
