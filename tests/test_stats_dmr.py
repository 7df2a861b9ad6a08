import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cytolake.functions import stats
from cytolake.operators import dmr, intervals, neighbors


def brute_midp(mc, mt, nc, nt):
    m, n, k = mc + nc, mt + nt, mc + mt
    p = {x: math.comb(m, x) * math.comb(n, k - x) / math.comb(m + n, k) for x in range(max(0, k - n), min(k, m) + 1)}
    lo, hi = sum(v for x, v in p.items() if x < mc), sum(v for x, v in p.items() if x > mc)
    return min(1.0, 2 * min(lo + p[mc] / 2, hi + p[mc] / 2))


def test_midp_by_enumeration():
    assert stats.midp_fisher(8, 2, 1, 5) == pytest.approx(0.0253496503, abs=1e-9)
    rng = random.Random(1)
    for _ in range(200):
        t = [rng.randint(0, 30) for _ in range(4)]
        assert stats.midp_fisher(*t) == pytest.approx(brute_midp(*t), abs=1e-9)


@pytest.mark.parametrize(("method", "want"), [("BH", [0.025, 0.05, 0.05, 0.025, 0.5]), ("holm", [0.04, 0.09, 0.09, 0.025, 0.5]), ("hochberg", [0.04, 0.08, 0.08, 0.025, 0.5]), ("bonferroni", [0.05, 0.2, 0.15, 0.025, 1.0]), ("BY", [0.0570833, 0.1141667, 0.1141667, 0.0570833, 1.0]), ("none", [0.01, 0.04, 0.03, 0.005, 0.5])])
def test_adjusted_p(spark, method, want):
    df = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.005, 0.5])), "i int, pval double")
    got = [r.padj for r in stats.adjust(df, method=method).orderBy("i").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_hommel_by_closed_testing():
    rng = random.Random(2)
    import numpy as np

    for _ in range(20):
        p = [rng.random() for _ in range(5)]
        want = []
        for i in range(5):  # the largest Simes p of all sets that hold i
            sets = [s for k in range(1, 6) for s in itertools.combinations(range(5), k) if i in s]
            want.append(max(min(len(s) * q / (r + 1) for r, q in enumerate(sorted(p[j] for j in s))) for s in sets))
        assert list(stats.hommel(np.array(p))) == pytest.approx(want)


def test_hommel_of_many(spark):
    import time

    import numpy as np

    def plain(p):  # all numbers of largest hypotheses one by one
        n, s, best = len(p), np.sort(p), np.zeros(len(p))
        for k in range(1, n + 1):
            best = np.maximum(best, np.minimum(k * p, (k * s[n - k :] / np.arange(1, k + 1)).min()))
        return np.minimum(best, 1.0)

    rng = np.random.default_rng(3)
    families = {"a": rng.random(300) ** 4, None: rng.integers(0, 40, 300) / 50, "b": rng.random(1), "c": np.zeros(5), "d": np.arange(1, 200) ** 2 / 50_000, "e": 10.0 ** -rng.integers(0, 320, 100)}
    rows = [(f, i, float(v)) for f, p in families.items() for i, v in enumerate(p)]
    df = spark.createDataFrame([*rows, ("a", -1, None), ("a", -2, math.nan)], "f string, i int, p double")
    got = {(r.f, r.i): r.q for r in stats.adjust(df, "p", "hommel", ["f"], out="q").collect()}
    assert len(got) == len(rows) + 2 and got.pop(("a", -1)) is None and got.pop(("a", -2)) is None
    for f, p in families.items():
        assert [got[f, i] for i in range(len(p))] == pytest.approx(list(plain(p)), rel=1e-9, abs=0)
        assert list(stats.hommel(p)) == pytest.approx(list(plain(p)), rel=1e-9, abs=0)
    one = stats.adjust(df.where("f = 'a'"), "p", "hommel", out="q").where("i >= 0").orderBy("i").collect()
    assert [r.q for r in one] == pytest.approx(list(plain(families["a"])))
    p, began = rng.random(200_000) ** 2, time.time()
    q = stats.hommel(p)
    assert time.time() - began < 30 and (np.diff(q[np.argsort(p)]) >= -1e-12).all() and (q >= p).all()


def test_rank_sums(spark):
    df = spark.createDataFrame([("f", g, float(v)) for g, v in zip("aaabbbb", (1, 2, 4, 3, 5, 6, 7), strict=True)], "feature string, grp string, value double")
    r = {x.grp: x for x in stats.rank_sums(df).collect()}
    assert (r["a"].w, r["b"].w) == (1.0, 11.0) and not r["a"].ties
    assert stats.rank_sum_p(3, 4, 1.0, None, False) == pytest.approx(4 / 35)


def _as_sql(tables, body):
    """What the queries' SQL gives for 2x2 tables: tests is a relation of these."""
    import duckdb

    from cytolake.plans.queries import CTES

    rows = ", ".join(f"({i}, {mc}::BIGINT, {mt}::BIGINT, {nc}::BIGINT, {nt}::BIGINT)" for i, (mc, mt, nc, nt) in enumerate(tables))
    with duckdb.connect() as c:
        return c.execute(f"WITH tests(i, mc, mt, nc, nt) AS (VALUES {rows}),\n" + ",\n".join(CTES[k] for k in ("fc", "midp", "dmr")) + body).fetchall()


def _tested(spark, tables):
    return stats.with_midp(dmr.with_log_fc(spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, mc bigint, mt bigint, nc bigint, nt bigint")))


def test_p_on_the_threshold_as_sql(spark):
    tables = [(0, 8, 2, 5), (2, 5, 0, 8), (5, 2, 8, 0), (8, 0, 5, 2), (0, 16, 1, 3), (16, 0, 3, 1), (0, 20, 1, 4), (1, 4, 0, 20), (4, 1, 20, 0), (3, 40, 20, 30), (9, 9, 9, 9)]
    assert all(brute_midp(*t) == pytest.approx(0.2, abs=1e-12) for t in tables[:9])
    want = {i for (i,) in _as_sql(tables, " SELECT i FROM dmr")}
    got = dmr.filter_dmr(_tested(spark, tables), "none", p_threshold=0.2, log_threshold=0.3)
    assert {r.i for r in got.collect()} == want


def test_p_between_two_decimals_as_sql(spark):
    tables = [(1, 9, 0, 246), (1, 13, 0, 242), (0, 26, 1, 229), (0, 30, 1, 225), (0, 34, 1, 221), (1, 33, 0, 222), (9, 9, 9, 9), (300, 200, 299, 200), (292, 227, 768, 597)]
    n = len(tables)
    want = _as_sql(tables, f""" SELECT i, mc, mt, nc, nt, "logFC"::VARCHAR, round(pval, 6), round(least(1, pval * {n}), 6), CASE WHEN "logFC" < 0 THEN 'hypo' ELSE 'hyper' END FROM fc JOIN midp USING (mc, mt, nc, nt) ORDER BY i""")
    kept = dmr.filter_dmr(_tested(spark, tables), keep_all=True)
    assert kept.columns == ["i", "mc", "mt", "nc", "nt", "logFC", "pval", "padj", "direction"]
    got = kept.withColumns({c: F.round(c, 6) for c in ("pval", "padj")}).orderBy("i").collect()
    assert [(*r[:5], str(r.logFC), *r[6:]) for r in got] == want


def test_fold_change_that_rounds_to_zero_as_sql(spark):
    tables = [(292, 227, 768, 597), (768, 597, 292, 227), (9, 9, 9, 9), (0, 9, 0, 9), (0, 9, 9, 9), (9, 0, 0, 9), (300, 200, 299, 200)]
    want = _as_sql(tables, ' SELECT "logFC"::VARCHAR FROM fc ORDER BY i')
    assert [x for (x,) in want[:3]] == ["-0.0", "0.0", "0.0"]
    got = _tested(spark, tables).orderBy("i").collect()
    assert [r.logFC if r.logFC is None else str(r.logFC) for r in got] == [x for (x,) in want]


def test_infinite_fold_changes(spark):
    df = spark.createDataFrame([("chr1", 0, 1, "g", 0, 10, 5, 5), ("chr1", 1, 2, "g", 5, 5, 0, 10), ("chr1", 2, 3, "g", None, None, None, None)], "chr string, start bigint, end bigint, test string, mc bigint, mt bigint, nc bigint, nt bigint")
    got = [r.logFC for r in dmr.with_log_fc(df).orderBy("start").collect()]
    assert got == [-math.inf, math.inf, None]


def test_group_minimum_is_strict(spark):
    sums = spark.createDataFrame([("a", "chr1", 0, 500, 2, 1), ("b", "chr1", 0, 500, 5, 5)], "grp string, chr string, start bigint, end bigint, c bigint, t bigint")
    assert {r.mc for r in dmr.each_vs_all(sums, 3, 3).collect()} == {None}
    assert {r.mc for r in dmr.each_vs_all(sums, 3, 2).collect()} == {2, 5}


def test_adjacent_intervals_merge(spark):
    rows = [("t", "chr1", s, e, 0.01, 2.0, "hyper") for s, e in ((0, 100), (101, 200), (202, 300))]
    df = spark.createDataFrame(rows, "test string, chr string, start bigint, end bigint, padj double, logFC double, direction string")
    got = [(r.dmr_start, r.dmr_end, r.dmr_length) for r in dmr.collapse_dmr(df, 0, 0).orderBy("dmr_start").collect()]
    assert got == [(0, 200, 200), (202, 300, 98)]


def test_merged_directions_average_magnitudes(spark):
    df = spark.createDataFrame([("t", "chr1", 0, 600, 0.1, -2.0, "hypo"), ("t", "chr1", 500, 2000, 0.3, 1.0, "hyper")], "test string, chr string, start bigint, end bigint, padj double, logFC double, direction string")
    r = dmr.collapse_dmr(df, 0, 1000, True).first()
    assert (r.dmr_logFC, r.dmr_length) == (1.5, 2000)


def test_joins_by_nested_loops(spark):
    rng = random.Random(7)
    make = lambda n, w: [(f"chr{rng.randint(1, 2)}", s, s + rng.randrange(w)) for s in (rng.randrange(5000) for _ in range(n))]
    a, b = make(60, 900), make(60, 900)
    fa, fb = (spark.createDataFrame(x, "chr string, start bigint, end bigint") for x in (a, b))
    want = sum(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for x in a for y in b)
    assert intervals.overlap_join(fa, fb, bin_width=300).count() == want
    points = [(f"chr{rng.randint(1, 2)}", rng.randrange(6000)) for _ in range(100)]
    fp = spark.createDataFrame(points, "chr string, pos bigint")
    assert intervals.range_join(fp, fb, bin_width=250).count() == sum(p[0] == y[0] and y[1] <= p[1] <= y[2] for p in points for y in b)
    assert intervals.range_join(fp, fb, False, bin_width=250).count() == sum(p[0] == y[0] and y[1] <= p[1] < y[2] for p in points for y in b)


def test_promoters_and_gene_choice(spark):
    g = spark.createDataFrame([("chr1", 10000, 20000, "A", 1, "+"), ("chr1", 10000, 20000, "B", 2, "-"), ("chr1", 1, 90000, "A", 3, "+")], "chr string, start bigint, end bigint, gene_name string, ord bigint, strand string")
    p = {r.gene_name: (r.start, r.end) for r in intervals.promoters(intervals.first_genes(g)).collect()}
    assert p == {"A": (8500, 11500), "B": (18500, 21500)}
    assert {r.gene_name: (r.start, r.end) for r in intervals.gene_ranges(g).collect()}["A"] == (0, 95000)


def test_label_votes(spark):
    e = spark.createDataFrame([("q", [0.0]), ("n1", [1.0]), ("n2", [2.0]), ("n3", [3.0]), ("n4", [4.0])], "cell_id string, vec array<double>")
    labels = spark.createDataFrame([("q", None), ("n1", "B"), ("n2", "A"), ("n3", "B"), ("n4", "A")], "cell_id string, label string")
    assert neighbors.transfer_labels(e, labels, 4).where("cell_id = 'q'").first().label == "A"
    c = spark.createDataFrame([(1, "T"), (1, "T"), (2, "T"), (3, "B")], "cluster_id int, type string")
    assert [r.label for r in neighbors.transfer_cluster_labels(c).orderBy("cluster").collect()] == ["T", "T.1", "B"]


def test_log_factorials():
    import numpy as np

    n = np.array([0, 1, 10, 65535, 65536, 10**7])
    assert stats.log_factorials(n) == pytest.approx([math.lgamma(x + 1) for x in n], rel=1e-12)


def test_bad_regions_raise(spark):
    with pytest.raises(Exception, match="not chr_start_end"):
        intervals.parse_regions(spark.createDataFrame([("chr1_5",)], "region string")).collect()
    assert intervals.parse_regions(spark.createDataFrame([("chr1_5_9",)], "region string")).select(F.sum("end")).first()[0] == 9


def test_midp_of_deep_tables_is_the_whole_sum():
    """Sums over the significant range equal those over all tables; a batch gives what its rows give one by one."""
    import numpy as np

    rng = random.Random(4)
    tables = [[rng.randint(0, 4000) for _ in range(4)] for _ in range(20)] + [[0, 0, 0, 0], [5, 0, 0, 5], [100_000, 900_000, 101_000, 899_000], [1, 2_000_000, 3, 5]]
    batch = stats.midp_fisher(*np.array(tables).T)
    for t, got in zip(tables, batch, strict=True):
        assert got == pytest.approx(stats.midp_fisher(*t)[0])
    for t, got in zip(tables[:5], batch, strict=False):
        mc, mt, nc, nt = t
        logs = [-sum(math.lgamma(v + 1) for v in (x, mc + nc - x, mc + mt - x, nt + mt - (mc + mt - x))) for x in range(max(0, mc - nt), min(mc + nc, mc + mt) + 1)]
        top = max(logs)
        p = [math.exp(v - top) for v in logs]
        k = mc - max(0, mc - nt)
        whole = sum(p)
        assert got == pytest.approx(min(1, 2 * min(sum(p[:k]) + p[k] / 2, sum(p[k + 1 :]) + p[k] / 2) / whole), rel=1e-6, abs=1e-12)


def test_tails_of_distributions():
    import numpy as np

    z = np.linspace(0, 12, 200)
    assert stats.normal_tail(z) == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z], rel=1e-9)
    assert math.isnan(stats.normal_tail(np.array([math.nan]))[0])
    for df in (1, 2, 3, 7, 30, 400):
        for t in (0.0, 0.3, 1.0, 2.5, 9.0):
            grid = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 20001)
            f = np.maximum(np.cos(grid), 0) ** (df - 1)
            area = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (grid[1] - grid[0]) / 3
            want = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * area
            assert stats.student_tail(t, df) == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_regression_p(spark):
    rows = [("a", float(i), 2.0 * i + (-1) ** i) for i in range(10)] + [("b", 1.0, 2.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("d", 1.0, 1.0), ("d", 2.0, 2.0), ("d", 3.0, 3.0)]
    got = {r.g: r for r in dmr.group_regression(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert 0 < got["a"].p_value < 1e-6 and got["b"].p_value is None and got["c"].p_value is None and got["d"].p_value == 0


def test_kendall_by_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (2, 3, 17, 120):
        x, y = rng.integers(0, 9, n), rng.integers(0, 30, n) + rng.integers(0, 9, n)
        dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        both = math.sqrt((dx != 0).sum() * (dy != 0).sum())
        assert stats.kendall(x, y) == pytest.approx((dx * dy).sum() / both if both else math.nan, nan_ok=True)
    assert math.isnan(stats.kendall(np.ones(5), np.arange(5)))


@pytest.mark.parametrize("tile", [7, 50, 10_000_000, None])
@pytest.mark.parametrize("gap", [0, 1, 5])
def test_islands_by_sweep(spark, tile, gap):
    """Tiles of any size give the islands of one sweep over a chromosome."""
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-40, 400), s + rng.choice([0, 1, 3, 10, 60])) for _ in range(150)]
    want = []
    for key in ("a", "b", None):
        own, open_ = sorted(r[1:] for r in rows if r[0] == key), []
        for s, e in own:
            if open_ and s <= open_[-1][1] + gap:
                open_[-1][1] = max(open_[-1][1], e)
            else:
                open_.append([s, e])
        want += [(key, s, e, *next(i for i in open_ if i[0] <= s and e <= i[1])) for s, e in own]
    df = spark.createDataFrame(rows, "chr string, start long, end long")
    got = [(r.chr, r.start, r.end, r.island_start, r.island_end) for r in intervals.islands(df, ["chr"], gap=gap, tile=tile).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_neighbours_in_chunks(monkeypatch):
    import numpy as np

    from cytolake.operators import neighbors

    monkeypatch.setattr(neighbors, "CHUNK", 16)
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 4, (30, 5)).astype(float), rng.integers(0, 4, (70, 5)).astype(float)
    for k in (1, 4, 40, 100):
        i, j, d = neighbors.nearest_rows(x, y, k)
        for r in range(30):
            exact = ((y - x[r]) ** 2).sum(1)
            order = np.lexsort((np.arange(70), exact))[:k]
            assert j[i == r].tolist() == order.tolist() and d[i == r].tolist() == exact[order].tolist()
