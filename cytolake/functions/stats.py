"""Statistical functions: mid-p Fisher test, Wilcoxon rank sums, adjustment of p-values."""

from __future__ import annotations

import ctypes
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_factorials(n: np.ndarray) -> np.ndarray:
    """log(n!) of whole numbers: a table by the C library's lgamma for small ones, Stirling's series beyond."""
    n = np.asarray(n, np.int64)
    out = _table()[np.minimum(n, len(_table()) - 1)]
    big = n >= len(_table())
    if big.any():
        x = n[big].astype(float) + 1
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return out


@lru_cache(1)
def _table(size: int = 1 << 16) -> np.ndarray:
    try:  # the function that SQL engines call: its last bits decide where a p-value lies on a threshold
        lgamma = ctypes.CDLL("libm.so.6").lgamma
        lgamma.argtypes, lgamma.restype = [ctypes.c_double], ctypes.c_double
    except (OSError, AttributeError):
        lgamma = math.lgamma
    return np.array([lgamma(float(n)) for n in range(1, size + 1)])


def midp_fisher(mc: np.ndarray, mt: np.ndarray, nc: np.ndarray, nt: np.ndarray) -> np.ndarray:
    """Two-sided mid-p of 2x2 tables: twice the smaller tail, the observed table counting half.

    Sums run over the tables within 40 standard deviations of the mean; what lies beyond is below the smallest number.
    Terms and sums are added up in the SQL's order, so that p-values on a threshold or between two decimals fall alike."""
    mc, mt, nc, nt = (np.asarray(x, np.int64).ravel() for x in (mc, mt, nc, nt))
    m, n, k = mc + nc, mt + nt, mc + mt
    total = np.maximum(m + n, 1).astype(float)
    mean = k * m / total
    reach = 40 * np.sqrt(mean * (n / total) * ((m + n - k) / np.maximum(total - 1, 1))) + 40
    low = np.maximum(np.maximum(0, k - n), np.floor(mean - reach).astype(np.int64))
    high = np.minimum(np.minimum(k, m), np.ceil(mean + reach).astype(np.int64))
    out = np.zeros(len(m))
    size = np.maximum(high - low + 1, 1)
    step = np.cumsum(size) // (1 << 21)  # so many terms at a time, or one table
    for part in np.split(np.arange(len(m)), np.flatnonzero(np.diff(step)) + 1) if len(m) else []:
        own = size[part]
        start = np.cumsum(own) - own
        t = np.repeat(part, own)
        x = np.repeat(low[part] - start, own) + np.arange(int(own.sum()))
        f_m, f_n, f_all, f_k, f_rest = (np.repeat(log_factorials(v[part]), own) for v in (m, n, m + n, k, m + n - k))
        p = np.exp(f_m - log_factorials(x) - log_factorials(m[t] - x) + f_n - log_factorials(k[t] - x) - log_factorials(n[t] - k[t] + x) - f_all + f_k + f_rest)
        below, at, above = (np.bincount(t - part[0], np.where(side, p, 0), len(part)) for side in (x < mc[t], x == mc[t], x > mc[t]))  # one by one, where reduceat adds in pairs
        below, above = below + at / 2, above + at / 2
        out[part] = np.minimum(1.0, 2 * np.minimum(below, above))
    return out


@F.pandas_udf(T.DoubleType())
def _midp(mc: pd.Series, mt: pd.Series, nc: pd.Series, nt: pd.Series) -> pd.Series:
    return pd.Series(midp_fisher(*(x.to_numpy() for x in (mc, mt, nc, nt))), dtype="float64")


def with_midp(df: DataFrame, cols: tuple[str, str, str, str] = ("mc", "mt", "nc", "nt"), out: str = "pval") -> DataFrame:
    """df with the mid-p of each row's table; each distinct table is worked out once. Rows with a null count get null."""
    tables = df.select(*cols).dropna().distinct().withColumn(out, _midp(*cols))
    return df.join(tables, list(cols), "left").select(*df.columns, out)  # a join by names puts these first


METHODS = ("none", "bonferroni", "holm", "hochberg", "hommel", "BH", "fdr", "BY")


def _p_bucket(p: Column) -> Column:
    """A number that grows with p and takes a bounded number of values: even steps above 1/64, powers of 2 below."""
    small = 1024 + 4 * (F.log2(F.greatest(p, F.lit(1e-300))) + 6)
    return F.floor(F.when(p >= 1 / 64, p * 65536).otherwise(small)).cast("int")


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, nulls being equal; the keys of a stay."""
    b = b.withColumnsRenamed({k: f"{k}_r_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_r_"))
    return a.join(b, on, how).drop(*[f"{k}_r_" for k in keys])


def adjust(df: DataFrame, p: str = "pval", method: str = "BH", by: list[str] | None = None, n: Column | None = None, out: str = "padj") -> DataFrame:
    """df with adjusted p-values, within `by` or over all rows; n: how many tests count, by default the p-values there.

    Adjusted values depend on p alone, so they are worked out for distinct p-values and joined back. These are dealt into
    a bounded number of buckets in order of p; ranks and running extremes within a bucket go on from what the buckets
    before it add up to, so no task sees the whole order. Null p-values stay null and are not counted. Hommel's method
    needs the lower hull of a family's ranks and p-values, which is the hull of its parts' hulls; it takes no n."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    by = by or []
    keys = [*by, "b_"]
    known = F.col(p).isNotNull() & ~F.isnan(p) if method == "hommel" else F.col(p).isNotNull()
    values = df.where(known).groupBy(*by, p).agg(F.count("*").alias("k_")).withColumn("b_", _p_bucket(F.col(p)))
    buckets = values.groupBy(*keys).agg(F.sum("k_").alias("kb_"))
    before = F.sum("kb_").over(Window.partitionBy(*by).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(*keys, F.coalesce(before, F.lit(0)).alias("before_"), F.sum("kb_").over(Window.partitionBy(*by)).cast("double").alias("n_"))
    inside = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _joined(values, buckets, keys).withColumn("last_", (F.col("before_") + F.sum("k_").over(inside)).cast("double")).withColumn("first_", F.col("last_") - F.col("k_") + 1)
    if method == "hommel":
        return _joined(df, _hommel(ranked, p, by, out), [*by, p], "left")
    x, tests = F.col(p), F.col("n_") if n is None else n.cast("double")
    raw, best = {
        "none": (x, None), "bonferroni": (x * tests, None), "holm": ((tests - F.col("first_") + 1) * x, F.max), "hochberg": ((tests - F.col("last_") + 1) * x, F.min),
        "BH": (x * tests / F.col("last_"), F.min), "fdr": (x * tests / F.col("last_"), F.min), "BY": (x * tests / F.col("last_"), F.min),
    }[method]
    ranked = ranked.withColumn("e_", raw)
    adjusted = F.col("e_")
    if best is not None:  # from the largest p down, or for Holm from the smallest up
        down = best is F.min
        outer = Window.partitionBy(*by).orderBy(F.desc("b_") if down else F.col("b_")).rowsBetween(Window.unboundedPreceding, -1)
        carry = ranked.groupBy(*keys).agg(best("e_").alias("m_")).withColumn("carry_", best("m_").over(outer)).drop("m_")
        run = best("e_").over(Window.partitionBy(*keys).orderBy(F.desc(p) if down else F.col(p)).rowsBetween(Window.unboundedPreceding, 0))
        ranked = _joined(ranked, carry, keys)
        adjusted = (F.least if down else F.greatest)(run, F.coalesce("carry_", run))
    if method == "BY":
        adjusted = adjusted * F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), tests.cast("int"))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    return _joined(df, ranked.select(*by, p, F.least(F.lit(1.0), adjusted).alias(out)), [*by, p], "left")


def lower_hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the lower convex hull of points in rising order of x."""
    keep: list[tuple[float, float]] = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        while len(keep) > 1 and (keep[-1][1] - keep[-2][1]) * (a - keep[-2][0]) >= (b - keep[-2][1]) * (keep[-1][0] - keep[-2][0]):
            keep.pop()
        keep.append((a, b))
    return tuple(np.array(keep, float).reshape(-1, 2).T)


def _hommel_at(p: np.ndarray, n: float, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values by the hull of all n (rank, p-value): the largest of min(k * p, Simes' bound of the k largest).

    That bound falls with k while k * p rises, so their crossing is searched. The bound is k times the least slope from
    (n - k, 0) to a later point; the line of that slope has all points above it, so it touches the hull."""
    slope = np.diff(value) / np.diff(last)
    cross = last[:-1] - value[:-1] / slope  # where the hull's edges meet 0

    def simes(k):
        at, best = np.searchsorted(cross, n - k), np.full(len(k), np.inf)
        for t in (at - 1, at, at + 1):
            t = np.clip(t, 0, len(last) - 1)
            j = last[t] - (n - k)
            best = np.minimum(best, np.where(j > 0, k * value[t] / np.maximum(j, 1), np.inf))
        return best

    low, high = np.ones(len(p)), np.full(len(p), float(n))
    while (low < high).any():
        k = np.ceil((low + high) / 2)
        below = k * p <= simes(k)
        low, high = np.where(below, k, low), np.where(below, high, k - 1)
    return np.minimum(np.maximum(low * p, np.where(low < n, simes(np.minimum(low + 1, n)), 0.0)), 1.0)


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values."""
    value, which, count = np.unique(p, return_inverse=True, return_counts=True)
    return _hommel_at(value, len(p), *lower_hull(np.cumsum(count), value))[which] if len(p) else np.zeros(0)


def _hommel(ranked: DataFrame, p: str, by: list[str], out: str) -> DataFrame:
    """by, p, out of distinct p-values (columns by, p, b_, last_, n_). Neighbouring buckets share a task; a family's hull goes
    to each of its tasks."""
    ranked = ranked.select(*by, p, "last_", "n_", F.when(F.col("b_") >= 1024, 1000 + F.floor(F.col("b_") / 1024)).otherwise(F.floor(F.col("b_") / 16)).alias("part_"))
    keys, kinds = [*by, "part_"], [ranked.schema[c] for c in by]
    point = [T.StructField("hx_", T.DoubleType()), T.StructField("hy_", T.DoubleType())]

    def corners(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("last_")
        x, y = lower_hull(part["last_"].to_numpy(), part[p].to_numpy(float))
        return pd.concat([part[by].iloc[[0] * len(x)].reset_index(drop=True), pd.DataFrame({"hx_": x, "hy_": y})], axis=1)

    def adjusted(part: pd.DataFrame, hull: pd.DataFrame) -> pd.DataFrame:
        hull = hull.sort_values("hx_")
        part[out] = _hommel_at(part[p].to_numpy(float), part["n_"].iloc[0], *lower_hull(hull["hx_"].to_numpy(), hull["hy_"].to_numpy()))
        return part[[*by, p, out]]

    hulls = ranked.groupBy(*keys).applyInPandas(corners, T.StructType([*kinds, *point]))
    sent = _joined(ranked.select(*keys).distinct(), hulls, by).select(*[F.col(c).alias(c) for c in (*keys, "hx_", "hy_")])
    schema = T.StructType([*kinds, ranked.schema[p], T.StructField(out, T.DoubleType())])
    return ranked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(adjusted, schema)


def rank_sums(df: DataFrame, feature: str = "feature", group: str = "grp", value: str = "value") -> DataFrame:
    """feature, grp, n1, n2, w, z, mean1, mean2, ties: the rank-sum statistic of each group against all others.

    Ranks are averaged over ties; z has tie and continuity correction. All groups share a feature's ranks, so values
    are ranked once."""
    by = Window.partitionBy(feature)
    order, same = by.orderBy(value), Window.partitionBy(feature, value)
    ranked = df.where(F.col(value).isNotNull()).select(
        feature, group, value, (F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0).alias("r"), F.count("*").over(same).cast("double").alias("tie"), F.count("*").over(by).cast("double").alias("all"), F.sum(value).over(by).alias("total"),
    )
    ranked = ranked.withColumn("tied", F.sum(F.col("tie") * F.col("tie") - 1).over(by))
    g = ranked.groupBy(feature, group).agg(F.count("*").cast("double").alias("n1"), F.sum("r").alias("sum_r"), F.first("all").alias("n"), F.first("tied").alias("tied"), F.sum(value).alias("s"), F.first("total").alias("total"))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    w = F.col("sum_r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1))))
    off = w - n1 * n2 / 2
    z = F.try_divide(off - F.signum(off) * 0.5, spread)
    return g.select(
        feature, group, n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), w.alias("w"), z.alias("z"),
        F.try_divide(F.col("s"), n1).alias("mean1"), F.try_divide(F.col("total") - F.col("s"), n2).alias("mean2"), (F.col("tied") > 0).alias("ties"),
    )


@lru_cache(256)
def _rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """In how many ways each value of the statistic comes about without ties, as shares of all ways."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):  # the j-th smallest value belongs to the first group or not
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            if shift <= n2:
                ways[i, shift:] += ways[i - 1, : ways.shape[1] - shift]
    return ways[n1] / ways[n1].sum()


def rank_sum_p(n1: np.ndarray, n2: np.ndarray, w: np.ndarray, z: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Two-sided p: exact when both groups are below 50 and nothing is tied, else by the normal approximation.

    Rows of the same group sizes share a distribution and are looked up together."""
    n1, n2 = (np.asarray(x, np.int64).ravel() for x in (n1, n2))
    w, z = (np.asarray(x, float).ravel() for x in (w, z))
    ties = np.asarray(ties, bool).ravel()
    out = 2 * normal_tail(np.abs(z))
    exact = (n1 > 0) & (n2 > 0) & (n1 < 50) & (n2 < 50) & ~ties
    sizes, which = np.unique(np.stack([n1[exact], n2[exact]], 1), axis=0, return_inverse=True)
    rows = np.flatnonzero(exact)
    for i, (a, b) in enumerate(sizes.tolist()):
        own = rows[which.ravel() == i]
        below = np.cumsum(_rank_sum_counts(a, b))
        at = np.rint(w[own]).astype(np.int64)
        upper = np.cumsum(_rank_sum_counts(a, b)[::-1])[::-1]
        out[own] = np.minimum(1.0, 2 * np.where(w[own] <= a * b / 2, below[at], upper[at]))
    out[(n1 == 0) | (n2 == 0)] = np.nan
    return out


def normal_tail(z: np.ndarray) -> np.ndarray:
    """How likely a standard normal value is above z >= 0: by a series up to 3, by a continued fraction beyond."""
    z = np.asarray(z, float)
    x = np.minimum(np.nan_to_num(z), 3.0)
    term, total = x.copy(), x.copy()
    for k in range(1, 60):
        term = term * x * x / (2 * k + 1)
        total = total + term
    near = 0.5 - np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total
    far = np.maximum(np.nan_to_num(z), 3.0)
    f = far.copy()
    for k in range(80, 0, -1):
        f = far + k / f
    return np.where(np.isnan(z), np.nan, np.where(z <= 3, near, np.exp(-far * far / 2) / math.sqrt(2 * math.pi) / f))


@F.pandas_udf(T.DoubleType())
def rank_sum_pvalue(n1: pd.Series, n2: pd.Series, w: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series(rank_sum_p(*(x.to_numpy() for x in (n1, n2, w, z.astype("float64"), ties))), dtype="float64")


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """How likely the absolute value of Student's t is at least |t|, by the incomplete beta function's continued fraction."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    x = df / (df + t * t)
    a, b = df / 2, np.full(df.shape, 0.5)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones(y.shape), 1 / (1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for up in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / (1 + up * d)
                c = 1 + up / c
                h = h * c * d
    part = np.where(y <= 0, 0.0, np.minimum(front * h, 1.0))
    return np.where(np.isnan(t), np.nan, np.where(flip, 1 - part, part))


@F.pandas_udf(T.DoubleType())
def student_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_tail(t.to_numpy(dtype="float64", na_value=np.nan), df.to_numpy(dtype="float64", na_value=np.nan)), dtype="float64")


def log2_ratio(a: Column, b: Column) -> Column:
    """log2(a / b) with infinities where one of them is 0, and null where both are or one is missing."""
    inf = F.lit(float("inf"))
    return F.when((a == 0) & (b == 0), None).when(a == 0, -inf).when(b == 0, inf).otherwise(F.log2(F.try_divide(a, b)))


def inversions(rank: np.ndarray) -> int:
    """How many pairs of whole numbers from 0 stand in falling order: bit by bit, a larger one before a smaller one whose
    higher bits are the same."""
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        rank = rank[np.argsort(rank >> (bit + 1), kind="stable")]
        one = rank >> bit & 1
        first = np.flatnonzero(np.concatenate(([True], np.diff(rank >> (bit + 1)) != 0)))
        ones = np.cumsum(one)
        before = np.repeat(ones[first] - one[first], np.diff(np.append(first, len(rank))))
        total += int((ones - before)[one == 0].sum())
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b, in memory and time that grow with the number of pairs of values (times its logarithm)."""
    n = len(x)
    if n < 2:
        return math.nan
    ties = lambda v: sum(c * (c - 1) // 2 for c in np.unique(v, return_counts=True, axis=0)[1].tolist())
    order = np.lexsort((y, x))
    falling = inversions(np.unique(y, return_inverse=True)[1][order])
    every, in_x, in_y = n * (n - 1) // 2, ties(x), ties(y)
    both = math.sqrt(every - in_x) * math.sqrt(every - in_y)
    return (every - in_x - in_y + ties(np.stack([x, y], 1)) - 2 * falling) / both if both else math.nan
