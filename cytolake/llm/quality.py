"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed n-grams: character n-grams and n-grams of its outline (runs of one character class taken
as one sign); beside them, in slots of their own, steps of the rates of repeats and markup. Indicators are scaled by the log ratio of the classes' smoothed counts,
and a linear hinge-loss model is fitted to them by dual coordinate descent. Held-back margins set the score's scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, copy_key, labelled_sample, read_table, tidy
from .textvec import word_hashes

#: Slots of hashed n-grams, and of what is no n-gram: rates of repeats and markup by steps, and the number of words.
HASHED, EXTRA = 1 << 15, 64
DIMS = HASHED + EXTRA
STEPS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
#: Positions whose n-grams are hashed at a time; bounds the working arrays whatever a text's length.
CHUNK = 1 << 20
MAX_SLICE = 2 << 20
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 4000

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_CLASS[[9, 11, 12, 13]] = 32


def _hash(columns: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(columns[0]), salt * 2654435761 & 0xFFFFFFFF, np.uint32)
    for c in columns:
        h = (h ^ c) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return h * np.uint32(0x9E3779B1) >> np.uint32(17)


def indicators(texts: list[str]) -> np.ndarray:
    """A row of DIMS flags for each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    flags = np.zeros((len(raw), DIMS), bool)
    data = np.frombuffer(b"".join(b"\n" + r + b"\n" for r in raw), np.uint8)
    bounds = np.cumsum([0, *(len(r) + 2 for r in raw)])

    def mark(values, bounds, n, salt):
        """The n-grams of values, of which those of a text stand between two bounds."""
        for at in range(0, len(values) - n + 1, CHUNK):
            seen = values[at : at + CHUNK + n - 1]
            row = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(np.clip(bounds - at, 0, len(seen))))
            m = len(seen) - n + 1
            inside = row[:m] == row[n - 1 :]
            flags[row[:m][inside], _hash([seen[k : k + m] for k in range(n)], salt)[inside]] = True

    for n in (1, 2, 3):
        mark(data, bounds, n, n)
    signs = _CLASS[data]
    keep = np.concatenate(([True], signs[1:] != signs[:-1]))
    keep[bounds[:-1]] = True
    outline, places = signs[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]
    for n in (4, 6):
        mark(outline, places, n, 10 + n)
    words, first = word_hashes(raw, fold_case=False)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own, n = words[a:b], b - a
        pairs = float((own[1:] == own[:-1]).sum()) / max(1, n)
        unlike = len(np.unique(own)) / max(1, n)
        lines = raw[i].split(b"\n")
        same = 1 - len(set(lines)) / len(lines)
        upper = sum(map(raw[i].count, (b"!!", b"|", b"***"))) / max(1, n)
        for k, v in enumerate((pairs, 1 - unlike, same, upper)):
            flags[i, HASHED + 8 * k : HASHED + 8 * k + 8] = [v >= level for level in STEPS]
        flags[i, HASHED + 32 + min(16, int(n).bit_length())] = True
    return flags


class Model:
    """Log-count ratios and hinge-loss weights of a labelled sample."""

    def __init__(self, sample: list[tuple[str, int]], folds: int = 3):
        y = np.array([v for _, v in sample], int)
        self.weights = None
        if len(set(y.tolist())) < 2:
            self.constant = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
            return
        sets = []
        for i in range(0, len(sample), 64):
            sets += [np.flatnonzero(f) for f in indicators([t for t, _ in sample[i : i + 64]])]
        fold = np.array([copy_key(t.split()) % folds for t, _ in sample])
        margins = np.zeros(len(y))
        for k in range(folds):
            rest = np.flatnonzero(fold != k)
            w, b = fit(sets, y, rest)
            for i in np.flatnonzero(fold == k):
                margins[i] = w[sets[i]].sum() + b
        self.a, self.c = _sigmoid(margins, y)
        self.weights, self.bias = fit(sets, y, np.arange(len(y)))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        z = [indicators(texts[i : i + 128]).astype(np.float32) @ self.weights.astype(np.float32) for i in range(0, len(texts), 128)]
        z = np.concatenate(z).astype(float) + self.bias if z else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.c, -30, 30)))


def fit(sets: list[np.ndarray], y: np.ndarray, rows: np.ndarray, cost: float = 1.0, alpha: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by feature, the log-count ratio included, and the intercept.

    Dual coordinate descent for the L1-loss support vector machine; rows are scaled to length 1 and the rarer class
    costs as much in all as the other."""
    counts = np.full((2, DIMS), alpha)
    for i in rows:
        counts[y[i], sets[i]] += 1
    ratio = np.log(counts[1] / (counts[1].sum() - alpha * DIMS + alpha)) - np.log(counts[0] / (counts[0].sum() - alpha * DIMS + alpha))
    share = y[rows].mean()
    limit = {1: cost * 0.5 / share, 0: cost * 0.5 / (1 - share)}
    xs, norms = {}, {}
    for i in rows:
        v = ratio[sets[i]]
        xs[i] = v / max(1e-9, np.sqrt((v * v).sum())) * 5
        norms[i] = (xs[i] ** 2).sum() + 1.0
    w, b = np.zeros(DIMS), 0.0
    dual = dict.fromkeys(rows.tolist(), 0.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(rows).tolist():
            s = 1.0 if y[i] else -1.0
            gradient = s * ((w[sets[i]] * xs[i]).sum() + b) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), limit[int(y[i])])
            if (step := (new - dual[i]) * s) != 0:
                w[sets[i]] += step * xs[i]
                b += step
                dual[i] = new
                moved += abs(step)
        if moved < 1e-3:
            break
    lengths = np.mean([np.sqrt((ratio[sets[i]] ** 2).sum()) for i in rows]) / 5
    return w * ratio / max(1e-9, lengths), b


def _sigmoid(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of y on z, by Newton steps with a small ridge."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        h = p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(c)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored as texts without words. Without usable labels all texts get one score. Rows are scored
    each by its text alone, so that repeated rows and equal texts have equal scores; an empty table gives none. Long texts
    are hashed in parts. Columns besides doc_id and text are not read."""
    model = docs.sparkSession.sparkContext.broadcast(Model(labelled_sample(docs, labels, "quality", sample)))

    def run(batches):
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                score = model.value.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
