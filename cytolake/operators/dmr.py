"""Differentially methylated regions: tests, filters, collapsing, annotation; cluster markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjust, log2_ratio, rank_sum_pvalue, rank_sums, student_pvalue, with_midp
from .intervals import islands, overlap_join

KEYS = ["chr", "start", "end"]


def each_vs_all(sums: DataFrame, min_total: int = 3, min_group: int = 3) -> DataFrame:
    """chr, start, end, test, mc, mt, nc, nt: each group's reads against all others' in windows with min_total reads.

    Where a side has min_group reads or fewer the counts are null."""
    w = Window.partitionBy(*KEYS)
    both = sums.withColumn("ac", F.sum("c").over(w)).withColumn("at", F.sum("t").over(w)).where(F.col("ac") + F.col("at") >= min_total)
    counts = both.select(*KEYS, F.concat("grp", F.lit("_all")).alias("test"), F.col("c").alias("mc"), F.col("t").alias("mt"), (F.col("ac") - F.col("c")).alias("nc"), (F.col("at") - F.col("t")).alias("nt"))
    return _masked(counts, min_group)


def compared(sums: DataFrame, comparisons: DataFrame, min_total: int = 3, min_group: int = 3) -> DataFrame:
    """The same for named comparisons: name, A, B with comma-separated groups; groups that are not there count nothing."""
    sides = comparisons.select("name", F.explode(F.split("A", r"\s*,\s*")).alias("grp"), F.lit(True).alias("first")).unionByName(comparisons.select("name", F.explode(F.split("B", r"\s*,\s*")).alias("grp"), F.lit(False).alias("first")))
    w = Window.partitionBy(*KEYS)
    enough = sums.withColumn("all_", F.sum(F.col("c") + F.col("t")).over(w)).where(F.col("all_") >= min_total)
    pick = lambda side, col: F.coalesce(F.sum(F.when(F.col("first") == side, F.col(col))), F.lit(0)).cast("bigint")
    counts = enough.join(F.broadcast(sides), "grp").groupBy(*KEYS, F.col("name").alias("test")).agg(pick(True, "c").alias("mc"), pick(True, "t").alias("mt"), pick(False, "c").alias("nc"), pick(False, "t").alias("nt"))
    return _masked(counts, min_group)


def _masked(counts: DataFrame, min_group: int) -> DataFrame:
    enough = (F.col("mc") + F.col("mt") > min_group) & (F.col("nc") + F.col("nt") > min_group)
    return counts.select(*KEYS, "test", *[F.when(enough, F.col(c)).alias(c) for c in ("mc", "mt", "nc", "nt")])


def with_log_fc(counts: DataFrame) -> DataFrame:
    rate = lambda c, t: F.try_divide(F.col(c).cast("double"), (F.col(c) + F.col(t)).cast("double"))
    exact = log2_ratio(rate("mc", "mt"), rate("nc", "nt"))
    rounded = F.round(exact, 4)  # loses the sign of what rounds to 0, which the SQL's round keeps
    return counts.withColumn("logFC", F.when((rounded == 0) & (exact < 0), F.lit(-0.0)).otherwise(rounded))


def test_dmr(sums: DataFrame, comparisons: DataFrame | None = None, min_total: int = 3, min_group: int = 3) -> DataFrame:
    """chr, start, end, test, mc, mt, nc, nt, pval, logFC by the mid-p Fisher test."""
    counts = each_vs_all(sums, min_total, min_group) if comparisons is None else compared(sums, comparisons, min_total, min_group)
    return with_midp(with_log_fc(counts))


test_dmr.__test__ = False  # not a test


def filter_dmr(tested: DataFrame, method: str = "bonferroni", level: str = "global", p_threshold: float = 0.01, log_threshold: float = 1.0, keep_all: bool = False) -> DataFrame:
    """tested with padj and direction; rows with padj below and |logFC| above the thresholds, unless keep_all.

    level global: one family of tests; withinGroup: a family for each test, as many as there are distinct windows."""
    known = tested.where(F.col("pval").isNotNull())
    if level == "global":
        out = adjust(known, method=method)
    else:
        windows = known.select(*KEYS).distinct().count()
        out = adjust(known, method=method, by=["test"], n=F.lit(float(windows)))
    out = out.withColumn("direction", F.when(F.col("logFC") < 0, "hypo").otherwise("hyper"))
    return out if keep_all else out.where((F.col("padj") < p_threshold) & (F.abs("logFC") > log_threshold))


def collapse_dmr(dmrs: DataFrame, max_dist: int = 0, min_length: int = 1000, merge_directions: bool = False) -> DataFrame:
    """test, chr, direction, dmr_start, dmr_end, dmr_length, dmr_padj, dmr_logFC: intervals of a test that touch, overlap or
    are up to 2 * max_dist apart are one. With merge_directions the direction is not told apart and the mean is of |logFC|."""
    keys = ["test", "chr"] + ([] if merge_directions else ["direction"])
    padded = dmrs.withColumn("s_", F.col("start") - max_dist).withColumn("e_", F.col("end") + max_dist)
    effect = F.abs("logFC") if merge_directions else F.col("logFC")
    grouped = islands(padded, keys, "s_", "e_").groupBy(*keys, "island_start", "island_end").agg(F.avg("padj").alias("dmr_padj"), F.avg(effect).alias("dmr_logFC"))
    out = grouped.select(*keys, (F.col("island_start") + max_dist).alias("dmr_start"), (F.col("island_end") - max_dist).alias("dmr_end"), "dmr_padj", "dmr_logFC")
    return out.withColumn("dmr_length", F.col("dmr_end") - F.col("dmr_start")).where(F.col("dmr_length") >= min_length)


def annotate(dmrs: DataFrame, genes: DataFrame) -> DataFrame:
    """dmrs with gene_names: the genes that they overlap, by start and name, each once; null where there is none."""
    first = genes.withColumn("n_", F.row_number().over(Window.partitionBy("gene_name").orderBy("ord"))).where("n_ = 1").select("chr", "start", "end", "gene_name")
    keys = ["test", "chr", "dmr_start", "dmr_end"] + (["direction"] if "direction" in dmrs.columns else [])
    placed = dmrs.select(*keys).withColumn("start", F.col("dmr_start")).withColumn("end", F.col("dmr_end"))
    names = overlap_join(placed, first, bin_width=10_000).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("b_start", "b_gene_name"))), lambda g: g["b_gene_name"]), ", ").alias("gene_names"))
    return dmrs.join(names, keys, "left").select(*dmrs.columns, "gene_names")


def cluster_markers(matrix: DataFrame, groups: DataFrame, nmin: int = 10, method: str = "bonferroni", min_values: bool = False) -> DataFrame:
    """feature, grp, n1, n2, mean1, mean2, w, p_val, p_adj, logFC, direction of each group against all others.

    Groups of fewer than nmin cells are skipped, by all their cells, or with min_values by their cells with a value."""
    joined = matrix.join(groups.select("cell_id", "grp"), "cell_id")
    ranks = rank_sums(joined)
    if min_values:
        ranks = ranks.where((F.col("n1") >= nmin) & (F.col("n2") >= nmin))
    else:
        sizes = groups.groupBy("grp").agg(F.count("*").alias("own"))
        sizes = sizes.withColumn("rest", F.sum("own").over(Window.partitionBy()) - F.col("own")).where((F.col("own") >= nmin) & (F.col("rest") >= nmin))
        ranks = ranks.join(sizes.select("grp"), "grp", "left_semi")
    tested = ranks.withColumn("p_val", rank_sum_pvalue("n1", "n2", "w", "z", "ties")).withColumn("logFC", log2_ratio(F.col("mean1"), F.col("mean2")))
    tested = tested.withColumn("direction", F.when(F.col("mean1") > F.col("mean2"), "hypermethylated").otherwise("hypomethylated"))
    return adjust(tested, "p_val", method, by=["grp"], out="p_adj")


def dual_rank_top(dmrs: DataFrame, k: int) -> DataFrame:
    """The k rows of each test and direction with the smallest sum of ranks by p and by effect, ties kept."""
    by = Window.partitionBy("test", "direction")
    key = [F.col(c) for c in KEYS]
    ranked = dmrs.withColumn("rank_p", F.row_number().over(by.orderBy("padj", *key))).withColumn("rank_fc", F.row_number().over(by.orderBy(F.desc(F.abs("logFC")), *key)))
    ranked = ranked.withColumn("total_rank", F.col("rank_p") + F.col("rank_fc"))
    return ranked.withColumn("r_", F.rank().over(by.orderBy("total_rank"))).where(F.col("r_") <= k).drop("r_")


def overlap_shares(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """by, overlaps, n, share: how many rows of a overlap a row of b, by a column of a."""
    hit = overlap_join(a, b, how="left").withColumn("overlaps", F.col("b_start").isNotNull()).dropDuplicates([*KEYS, by])
    counts = hit.groupBy(by, "overlaps").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def region_venn(sets: DataFrame) -> DataFrame:
    """chr, start, end and members: which sets (column name) have a region that overlaps each island of all sets' union."""
    grouped = islands(sets, ["chr"], tile=10_000_000).groupBy("chr", F.col("island_start").alias("start"), F.col("island_end").alias("end"))
    return grouped.agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("members"))


def covered_sites(regions: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites (chr, pos) that lie in a region: the per-base comparison without writing out every base."""
    from .intervals import range_join

    return range_join(sites, regions.select("chr", "start", "end")).select("chr", "pos").distinct()


def balanced_means(matrix: DataFrame, groups: DataFrame, bins: int = 33) -> DataFrame:
    """grp, bin, feature, value: each group's cells dealt in turn into bins, and their mean."""
    dealt = groups.withColumn("bin", ((F.row_number().over(Window.partitionBy("grp").orderBy("cell_id")) - 1) % bins).cast("int"))
    return matrix.join(dealt.select("cell_id", "grp", "bin"), "cell_id").groupBy("grp", "bin", "feature").agg(F.avg("value").alias("value"))


def group_regression(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, r2, p_value of y on x; p_value: of a slope of 0, null for fewer than three rows with both
    values and where x or y do not vary."""
    known = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = df.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), (known - 2).alias("df_"))
    rest = 1 - F.col("r2")  # t squared is r2 * df / rest
    t = F.when(rest <= 0, F.lit(float("inf"))).otherwise(F.sqrt(F.try_divide(F.col("r2") * F.col("df_"), rest)))
    usable = (F.col("df_") > 0) & F.col("slope").isNotNull() & F.col("r2").isNotNull() & ~F.isnan("r2")
    p = F.when(usable, student_pvalue(F.coalesce(t, F.lit(0.0)), F.greatest(F.col("df_"), F.lit(1)).cast("double")))
    return fit.withColumn("p_value", p).drop("df_")


def gene_list(annotated: DataFrame) -> DataFrame:
    """test, gene_name: the genes of annotated regions, one by one."""
    return annotated.where("gene_names is not null").select("test", F.explode(F.split("gene_names", ", ")).alias("gene_name")).distinct()
