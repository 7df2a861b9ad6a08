"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are rates and densities: hits in a lexicon, their nearness to second-person words, capitals, punctuation, and
words whose letters are disguised. The lexicon (whole words and word beginnings) is learned from the labelled sample;
each fold's features come from the other folds' lexicon, so that trees do not learn from words seen with their label.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, copy_key, labelled_sample, read_table, tidy

MAX_SLICE = 4 << 20
#: Characters that stand for letters in disguised words, and words that address the reader.
DISGUISES = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "*": ""})
SECOND_PERSON = {"you", "your", "yours", "u", "ur", "youre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "vous", "votre", "vos", "ton", "ta", "tú", "ti", "usted", "ustedes", "vosotros"}
EDGE = ".,;:!?\"'()[]{}<>«»„“”…-*"
UPPER = bytes(range(65, 91))
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
PREFIXES = (4, 5, 6)


def plain(word: str) -> str:
    """A word in lower case without what surrounds it."""
    return word.strip(EDGE).lower()


def undisguised(word: str) -> str:
    return word.lower().translate(DISGUISES).strip(EDGE)


def beginnings(word: str) -> list[str]:
    """The lexicon entries that a word could hit: itself, and its beginnings, marked as such."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def entry_counts(texts: list[str], y: list[int], folds: list[int]) -> list[list[Counter]]:
    """By fold and label: in how many texts each entry is, near copies counting as one text. The key None counts texts."""
    seen = set()
    counts = [[Counter(), Counter()] for _ in range(max(folds, default=0) + 1)]
    for text, label, fold in zip(texts, y, folds, strict=True):
        raw = text.split()
        key = (copy_key([plain(w) for w in raw]), label)
        if key in seen:
            continue
        seen.add(key)
        entries = set()
        for w in set(raw):
            forms = {plain(w)} if w.isalpha() else {plain(w), undisguised(w)}
            for form in forms:
                if len(form) > 2:
                    entries.update(beginnings(form))
        counts[fold][label].update(entries)
        counts[fold][label][None] += 1
    return counts


def lexicon_of(counts: list[list[Counter]], min_docs: int = 3, min_ratio: float = 8.0, size: int = 4000) -> dict[str, float]:
    """Entries and their log odds: in at least min_docs toxic texts, min_ratio times more often than in others; the size
    best ones, which bounds the model that goes to the tasks."""
    toxic, other = (sum((c[label] for c in counts), Counter()) for label in (1, 0))
    n_toxic, n_other = toxic.pop(None, 0), other.pop(None, 0)
    odds = {}
    for e, c in toxic.items():
        if c >= min_docs:
            r = math.log((c + 0.5) / (n_toxic + 1)) - math.log((other[e] + 0.5) / (n_other + 1))
            if r >= math.log(min_ratio):
                odds[e] = r
    return dict(sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:size])


class Hits(dict):
    """word -> (weight, is disguised or None, is second person), worked out at first sight; emptied when it gets large."""

    def __init__(self, lexicon: dict[str, float], limit: int = 150_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit
        self.roots = {e.rstrip("~")[: PREFIXES[0]] for e in lexicon}

    def weight(self, word: str) -> float:
        if word[: PREFIXES[0]] not in self.roots:
            return 0.0
        return max((self.lexicon.get(e, 0.0) for e in beginnings(word)), default=0.0)

    def __missing__(self, raw: str):
        if len(self) >= self.limit:
            self.clear()
        word = raw.lower() if raw.isalpha() else plain(raw)
        w, odd = self.weight(word), False
        if not word.isalpha() and len(word) > 2:
            other = undisguised(raw)
            odd = other.isalpha() and any(c.isalpha() for c in word) and other != word
            if odd:
                w = max(w, self.weight(other))
        found = (w, odd, word in SECOND_PERSON) if w or odd or word in SECOND_PERSON else None
        self[raw] = found
        return found


FEATURES = ("log_words", "hit_density", "hit_weight_density", "max_weight", "log_hits", "log_distinct_hits", "near_second_person", "second_person_rate", "capital_rate", "punctuation_rate", "exclamation_rate", "disguise_rate")


def features(text: str, hits: Hits, near: int = 5) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    found = [(i, f) for i, f in enumerate(map(hits.__getitem__, words)) if f]
    toxic = [(i, f[0]) for i, f in found if f[0]]
    people = np.array([i for i, f in found if f[2]])
    close = 0
    if toxic and len(people):
        at = np.array([i for i, _ in toxic])
        k = np.searchsorted(people, at)
        gap = np.minimum(np.abs(people[np.minimum(k, len(people) - 1)] - at), np.abs(people[np.maximum(k - 1, 0)] - at))
        close = int((gap <= near).sum())
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    weight = sum(w for _, w in toxic)
    return [
        math.log1p(len(words)), len(toxic) / n, weight / n, max((w for _, w in toxic), default=0.0), math.log1p(len(toxic)), math.log1p(len({words[i] for i, _ in toxic})),
        close / max(1, len(toxic)), len(people) / n, (len(raw) - len(raw.translate(None, UPPER))) / size, (len(raw) - len(raw.translate(None, PUNCT))) / size,
        raw.count(b"!") / n, sum(1 for _, f in found if f[1]) / n,
    ]


class Trees:
    """Boosted regression trees on logistic loss, over binned features; trees are arrays that predict all rows at once."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, min_leaf: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.min_leaf = rounds, depth, rate, bins, ridge, min_leaf
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            z += self._leaves(tree, x)
        return self

    def _grow(self, binned, g, h):
        """A complete tree in heap order: feature (-1: none), cut and value of each node."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(g), int)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = self.rate * gs / (hs + self.ridge)
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for f, cuts in enumerate(self.cuts):
                gl = np.bincount(binned[rows, f], g[rows], len(cuts) + 1).cumsum()[:-1]
                hl = np.bincount(binned[rows, f], h[rows], len(cuts) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < self.min_leaf) | (hs - hl < self.min_leaf)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        return feature, cut, value

    def _leaves(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            step = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
            at = np.where(f >= 0, step, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._leaves(t, x) for t in self.trees)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the nondecreasing step fit of y on z, as points to interpolate between.

    A prior of one observation at each end keeps scores off 0 and 1."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(z[order], y[order].astype(float), strict=True):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.array([(b[0] + 0.5 * (b[0] / b[1])) / (b[1] + 0.5) for b in blocks for _ in range(2)])
    return xs, np.clip(ys, 0.001, 0.999)


class Model:
    """Lexicon, trees and calibration, fitted on a labelled sample."""

    def __init__(self, sample: list[tuple[str, int]], folds: int = 4):
        texts, y = [t for t, _ in sample], np.array([v for _, v in sample], int)
        self.lexicon: dict[str, float] = {}
        self.trees = None
        if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of the only label, or one half
            self.constant = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.001
            return
        fold = np.array([copy_key([plain(w) for w in t.split()]) % folds for t in texts])
        counts = entry_counts(texts, y.tolist(), fold.tolist())
        x = np.zeros((len(texts), len(FEATURES)))
        for k in range(len(counts)):
            mine = np.flatnonzero(fold == k)
            hits = Hits(lexicon_of(counts[:k] + counts[k + 1 :]))
            for i in mine:
                x[i] = features(texts[i], hits)
        out = np.zeros(len(texts))
        for k in range(folds):  # margins of texts that the trees have not seen, for calibration
            mine, rest = fold == k, fold != k
            out[mine] = Trees().fit(x[rest], y[rest]).margin(x[mine]) if len(set(y[rest].tolist())) == 2 else 0
        self.xs, self.ys = isotonic(out, y)
        self.trees = Trees().fit(x, y)
        self.lexicon = lexicon_of(counts)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.interp(self.trees.margin(x), self.xs, self.ys)


#: Labelled rows that the model is fitted on, at most.
SAMPLE = 4000


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored as texts without words. Without usable labels all texts get one score. Rows are scored
    each by its text alone, so that repeated rows and equal texts have equal scores; an empty table gives none. Long texts
    are split into words whole, in memory that grows with the text. Columns besides doc_id and text are not read."""
    model = docs.sparkSession.sparkContext.broadcast(Model(labelled_sample(docs, labels, "toxic", sample)))

    def run(batches):
        m = model.value
        hits = Hits(m.lexicon)
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                x = np.array([features(t.as_py() or "", hits) for t in part.column("text")]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.score(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose texts are not scored as toxic, in the columns of docs, which may have any names besides doc_id
    and text. Null and empty texts are scored like others; repeated rows go or stay together; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(Model(labelled_sample(docs, labels, "toxic", sample)))

    def run(batches):
        m = model.value
        hits = Hits(m.lexicon)
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                x = np.array([features(t.as_py() or "", hits) for t in part.column("text")]).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(m.score(x) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
