import random

import pytest
from pyspark.sql import functions as F

from cytolake import cli
from cytolake.operators import windows

CALLS = "cell_id string, chr string, pos bigint, c bigint, t bigint"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALLS)


def test_bin_edges(spark):
    df = windows.step_windows(calls(spark, [("a", "chr1", p, 1, 0) for p in (1, 499, 500, 501, 1000)]), 500)
    assert [r.start for r in df.orderBy("pos").collect()] == [0, 0, 500, 500, 1000]


def test_offsets_floor_below_zero(spark):
    r = windows.step_windows(calls(spark, [("a", "chr1", 100, 1, 0)]), 1500, 500).first()
    assert (r.start, r.end) == (-1000, 500)


def test_site_with_both_counts(spark):
    r = windows.count_sites(windows.step_windows(calls(spark, [("a", "chr1", 5, 2, 1)]), 500), ["cell_id", "start"]).first()
    assert (r.m, r.u, r.n) == (1, 1, 3)
    assert windows.make_windows(calls(spark, [("a", "chr1", 5, 2, 1)]), stepsize=500).first().value == 50.0


def test_min_reads(spark):
    one = windows.make_windows(calls(spark, [("a", "chr1", 5, 1, 0)]), stepsize=500)
    two = windows.make_windows(calls(spark, [("a", "chr1", 5, 1, 0), ("a", "chr1", 6, 0, 1)]), stepsize=500)
    assert one.count() == 0 and two.count() == 1


@pytest.mark.parametrize(("v", "g", "want"), [(0.9, 0.8, 0.5), (0.4, 0.8, -0.5), (0.8, 0.8, 0.0)])
def test_score(spark, v, g, want):
    assert spark.range(1).select(windows.metric_of(F.lit(v), F.lit(g), "score").alias("s")).first().s == want


def test_closed_and_half_open_regions(spark):
    df = calls(spark, [("a", "chr1", p, 1, 0) for p in (99, 100, 200, 201)])
    region = spark.createDataFrame([("chr1", 100, 200)], "chr string, start bigint, end bigint")
    assert windows.range_join(df, region).count() == 2
    assert windows.custom_windows(df, region).count() == 1


def test_alternative_chromosomes_are_left_out(spark):
    df = calls(spark, [("a", c, 5, 1, 1) for c in ("chr1", "chrM", "chr1_alt", "KI270728", "chrEBV")])
    assert [r.chr for r in windows.make_windows(df, stepsize=500).collect()] == ["chr1"]


def test_smoothing_edges(spark):
    cells = spark.createDataFrame([("a", "g")], "cell_id string, grp string")
    sizes = spark.createDataFrame([("chr1", 5000)], "chr string, size bigint")
    run = lambda pos, compat: windows.smoothed_windows(calls(spark, [("a", "chr1", pos, 1, 0)]), cells, sizes=sizes, compat=compat).select("start").collect()
    assert [r.start for r in run(10, True)] == [500]
    assert run(4600, True) == []
    assert [r.start for r in run(4600, False)] == [4000]


def test_smoothing_is_a_dense_rolling_sum(spark):
    rng = random.Random(3)
    rows = [("a", f"chr{rng.randint(1, 2)}", rng.randrange(20000), rng.randint(0, 2), rng.randint(0, 2)) for _ in range(60)]
    cells = spark.createDataFrame([("a", "g")], "cell_id string, grp string")
    sizes = spark.createDataFrame([("chr1", 20000), ("chr2", 20000)], "chr string, size bigint")
    got = {(r.chr, r.start): (r.c, r.t) for r in windows.smoothed_windows(calls(spark, rows), cells, sizes=sizes, compat=False).collect()}
    want = {}
    for chr_ in ("chr1", "chr2"):
        for b in range(1, 39):
            near = [r for r in rows if r[1] == chr_ and abs(r[2] // 500 - b) <= 1]
            s = (sum(r[3] for r in near), sum(r[4] for r in near))
            if any(s):
                want[chr_, b * 500] = s
    assert got == want


def test_disjoint_windows_keep_all_reads(spark):
    rng = random.Random(5)
    df = calls(spark, [("a", "chr1", rng.randrange(9999), rng.randint(0, 2), 1) for _ in range(50)])
    total = df.agg(F.sum("c"), F.sum("t")).first()
    assert windows.aggregate_windows(windows.step_windows(df, 700)).agg(F.sum("c"), F.sum("t")).first() == total
    stepped = windows.aggregate_windows(windows.sliding_windows(df, 1500, 500)).agg(F.sum("c"), F.sum("t")).first()
    assert stepped == (total[0] * 3, total[1] * 3)


def test_arguments(spark):
    df = calls(spark, [("a", "chr1", 5, 1, 1)])
    with pytest.raises(ValueError):
        windows.make_windows(df)
    with pytest.raises(ValueError):
        windows.make_windows(df, stepsize=500, metric="mean")


def test_specifications():
    assert cli.parse_uniform("big=1500:500") == cli.WindowSpec("big", 1500, 500)
    assert cli.parse_uniform("1500:500").name == "1500_by_500"
    assert cli.parse_uniform("500").name == "500"
    with pytest.raises(ValueError):
        cli.parse_specs(["500", "500"], [])
    with pytest.raises(ValueError):
        cli.parse_uniform("x=y")
