"""Window aggregation: one counting kernel, window assigners, and metrics.

Assigners give every call its windows (chr, start, end or a feature name); the kernel counts methylated and
unmethylated sites and reads by cell or group and window; a metric turns counts into values. Everything stays long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import saved
from .intervals import first_genes, promoters, range_join

METRICS = ("percent", "score", "ratio")


def rounded(value: Column, digits: int, rounding: str = "half_up") -> Column:
    return F.bround(value, digits) if rounding == "half_even" else F.round(value, digits)


def step_start(pos: Column, step: int, offset: int = 0) -> Column:
    return (F.floor((pos - offset) / step) * step + offset).cast("bigint")


def step_windows(calls: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """calls with the start and end of their window of a fixed grid."""
    start = step_start(F.col("pos"), step, offset)
    return calls.withColumn("start", start).withColumn("end", start + step)


def sliding_windows(calls: DataFrame, size: int, step: int) -> DataFrame:
    """calls once for each of the size / step windows that hold them; starts are multiples of step and may be negative."""
    if size % step:
        raise ValueError("size must be a multiple of step")
    last = step_start(F.col("pos"), step)
    return calls.withColumn("start", F.explode(F.sequence(last - (size - step), last, F.lit(step).cast("bigint")))).withColumn("end", F.col("start") + size)


def count_sites(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: m and u (sites with methylated, unmethylated reads), n (reads), c and t (reads of either kind)."""
    return assigned.groupBy(*keys).agg(
        F.count_if(F.col("c") != 0).alias("m"), F.count_if(F.col("t") != 0).alias("u"), F.sum(F.col("c") + F.col("t")).alias("n"), F.sum("c").alias("c"), F.sum("t").alias("t"),
    )


def metric_of(rate: Column, g: Column | None, metric: str) -> Column:
    """percent, or score or ratio against the cell's global rate g."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric == "percent":
        return rate * 100
    if metric == "ratio":
        return F.round(F.try_divide(rate, g), 3)
    return F.round(F.when(rate > g, F.try_divide(rate - g, 1 - g)).otherwise(F.try_divide(rate - g, g)), 3)


def measured(counts: DataFrame, metric: str, digits: int, nmin: int, rates: DataFrame | None = None, rounding: str = "half_up") -> DataFrame:
    """counts with enough reads and their value; rates (cell_id, g) are needed for score and ratio."""
    kept = counts.where(F.col("n") >= nmin)
    rate = rounded(F.try_divide(F.col("m").cast("double"), (F.col("m") + F.col("u")).cast("double")), digits, rounding)
    if metric == "percent":
        return kept.withColumn("value", metric_of(rate, None, metric))
    if rates is None:
        raise ValueError("score and ratio need rates")
    return kept.join(rates, "cell_id").withColumn("value", metric_of(rate, F.col("g"), metric)).drop("g")


def regular_chromosomes(df: DataFrame) -> DataFrame:
    """Without alternative contigs and chromosomes that are never analysed."""
    return df.where(~F.col("chr").rlike("_|chrEBV|chrM|KI"))


def make_windows(
    calls: DataFrame, *, stepsize: int | None = None, bed: DataFrame | None = None, genes: DataFrame | None = None, promoter: bool = False,
    metric: str = "percent", nmin: int = 2, rates: DataFrame | None = None, groups: DataFrame | None = None, chromosomes: list[str] | None = None, rounding: str = "half_up",
    slide: int | None = None, save: str | None = None,
) -> DataFrame:
    """Values by cell (or, with groups, their mean by group) and window.

    Exactly one of stepsize, bed and genes. Step windows and regions give chr, start, end; genes give feature. slide:
    windows of stepsize begin every so many bases. groups: cell_id, grp. save: a path that the cells' values are written
    to first, by chromosome."""
    if sum(x is not None for x in (stepsize, bed, genes)) != 1:
        raise ValueError("give exactly one of stepsize, bed, genes")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    own = calls.where(F.col("chr").isin(chromosomes)) if chromosomes else calls
    if stepsize is not None:
        keys, digits, assigned = ["chr", "start", "end"], 3, regular_chromosomes(sliding_windows(own, stepsize, slide) if slide else step_windows(own, stepsize))
    elif bed is not None:
        keys, digits, assigned = ["chr", "start", "end"], 4, range_join(own, bed.select("chr", "start", "end"))
    else:
        chosen = first_genes(genes.where(F.col("type") == "gene") if "type" in genes.columns else genes)
        chosen = promoters(chosen) if promoter else chosen
        keys, digits, assigned = ["feature"], 4, range_join(own, chosen.select("chr", "start", "end", F.col("gene_name").alias("feature")))
    values = measured(count_sites(assigned, ["cell_id", *keys]), metric, digits, nmin, rates, rounding).select("cell_id", *keys, "value")
    values = saved(values, save)
    if groups is None:
        return values
    return values.join(groups.select("cell_id", "grp"), "cell_id").groupBy("grp", *keys).agg(F.avg("value").alias("value"))


def aggregate_windows(assigned: DataFrame, by: list[str] = ("cell_id",)) -> DataFrame:
    """Pre-aggregated windows: sums of c and t and numbers of sites where they are not zero; all-zero windows are left out."""
    out = assigned.groupBy(*by, "chr", "start", "end").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.count_if(F.col("c") != 0).alias("c_nz"), F.count_if(F.col("t") != 0).alias("t_nz"))
    return out.where((F.col("c") != 0) | (F.col("t") != 0))


def custom_windows(calls: DataFrame, windows: DataFrame) -> DataFrame:
    """calls with each of the given windows that holds them, ends excluded."""
    return range_join(calls, windows.select("chr", "start", "end"), closed=False)


def load_windows(agg: DataFrame, metric: str = "percent", nmin: int = 10, rates: DataFrame | None = None) -> DataFrame:
    """Values by cell and window from pre-aggregated windows; nmin counts sites."""
    keys = ["cell_id", "chr", "start", "end"]
    counts = agg.dropDuplicates().groupBy(*keys).agg(F.sum("c_nz").alias("m"), F.sum("t_nz").alias("u"), F.sum(F.col("c_nz") + F.col("t_nz")).alias("n"))
    return measured(counts, metric, 3, nmin, rates).select(*keys, "value")


def pseudobulk(calls: DataFrame, cells: DataFrame, step: int) -> DataFrame:
    """Reads by group, chr and bin number: c, t."""
    return calls.join(cells.select("cell_id", "grp"), "cell_id").groupBy("grp", "chr", F.floor(F.col("pos") / step).alias("bin")).agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def smoothed_windows(
    calls: DataFrame, cells: DataFrame, step: int = 500, smooth: int = 3, sizes: DataFrame | None = None, region: tuple[str, int, int] | None = None, compat: bool = True, save: str | None = None,
) -> DataFrame:
    """grp, chr, start, end, c, t, pct: centred sums over `smooth` bins of each group's reads.

    Bins hand their sums to their neighbours and one aggregation adds them up, so no sorted window over the genome is
    needed. sizes (chr, size): chromosome lengths, else the last call's bin ends the chromosome. Bins without a full
    neighbourhood are left out; compat also leaves out the last bin but one, as established results do. region: only
    windows that touch it, the scan being limited to it as well. save: a path that the sums are written to by chromosome."""
    half = (smooth - 1) // 2
    own = calls
    if region:
        name, lo, hi = region
        own = calls.where((F.col("chr") == name) & (F.col("pos") >= lo - (half + 1) * step) & (F.col("pos") <= hi + (half + 1) * step))
    last = (sizes.select("chr", F.ceil(F.col("size") / step).alias("bins")) if sizes is not None else calls.groupBy("chr").agg((F.floor(F.max("pos") / step) + 1).alias("bins")))
    bulk = pseudobulk(own, cells, step)
    spread = bulk.withColumn("bin", F.explode(F.sequence(F.col("bin") - half, F.col("bin") + half)))
    summed = spread.groupBy("grp", "chr", "bin").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    kept = summed.join(last, "chr").where((F.col("bin") >= half) & (F.col("bin") <= F.col("bins") - 1 - half - int(compat)))
    out = kept.where((F.col("c") != 0) | (F.col("t") != 0)).select("grp", "chr", (F.col("bin") * step).alias("start"), ((F.col("bin") + 1) * step).alias("end"), "c", "t")
    if region:
        out = out.where((F.col("start") <= hi) & (F.col("end") >= lo))
    return saved(out, save).withColumn("pct", percent_of("c", "t"))


def percent_of(c: str, t: str) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * F.col(c), (F.col(c) + F.col(t)).cast("double")), 2)


def load_smoothed_windows(agg: DataFrame, cells: DataFrame, trim: int = 500, nmin: int = 10, chunk: int | None = None) -> DataFrame:
    """grp, chr, start, end, c, t, pct from pre-aggregated windows, for groups of more than one cell.

    nmin counts sites of a group; with chunk it is applied to so many cells at a time, in order of id, before they are
    added up. Windows are trimmed on either side."""
    several = cells.groupBy("grp").agg(F.count_distinct("cell_id").alias("n_")).where("n_ > 1")
    chosen = cells.join(several, "grp", "left_semi").select("cell_id", "grp")
    part = F.lit(0)
    if chunk:
        part = F.floor((F.row_number().over(Window.partitionBy("grp").orderBy("cell_id")) - 1) / chunk)
    chosen = chosen.withColumn("part_", part)
    keys = ["grp", "chr", "start", "end"]
    parts = agg.dropDuplicates().join(chosen, "cell_id").groupBy(*keys, "part_").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum(F.col("c_nz") + F.col("t_nz")).alias("n"))
    out = parts.where(F.col("n") >= nmin).groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    return out.select("grp", "chr", (F.col("start") + trim).alias("start"), (F.col("end") - trim).alias("end"), "c", "t", percent_of("c", "t").alias("pct"))


def metacell_windows(calls: DataFrame, members: DataFrame, step: int = 50_000, metric: str = "score", nmin: int = 2, rates: DataFrame | None = None, metacell_rates: DataFrame | None = None) -> DataFrame:
    """Values by metacell and window: sites are counted and filtered by cell, then added up over members.

    members: metacell_id, cell_id. The metacell's rate is given, or the mean of its members' rates. Percent is not
    rounded; score and ratio are."""
    per_cell = count_sites(regular_chromosomes(step_windows(calls, step)), ["cell_id", "chr", "start", "end"]).where(F.col("n") >= nmin)
    keys = ["metacell_id", "chr", "start", "end"]
    pooled = per_cell.join(members, "cell_id").groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    rate = F.try_divide(F.col("m").cast("double"), (F.col("m") + F.col("u")).cast("double"))
    if metric == "percent":
        return pooled.select(*keys, (rate * 100).alias("value"))
    g = metacell_rates if metacell_rates is not None else members.join(rates, "cell_id").groupBy("metacell_id").agg(F.avg("g").alias("g"))
    return pooled.join(g, "metacell_id").select(*keys, metric_of(rate, F.col("g"), metric).alias("value"))


def metacell_smoothed_windows(calls: DataFrame, members: DataFrame, step: int = 1000, smooth: int = 3) -> DataFrame:
    """metacell_id, chr, start, end, c, t, pct: centred sums over neighbouring observed rows of a chromosome, by start.

    Rows are the windows that any metacell has; a metacell without reads there adds nothing. The ends of a chromosome
    have no full neighbourhood and are left out."""
    half = (smooth - 1) // 2
    bins = step_windows(calls, step).join(members, "cell_id").groupBy("metacell_id", "chr", "start").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    rows = bins.select("chr", "start").distinct()
    by_chr = Window.partitionBy("chr").orderBy("start")
    rows = rows.withColumn("row_", F.row_number().over(by_chr)).withColumn("rows_", F.count("*").over(Window.partitionBy("chr")))
    placed = bins.join(rows, ["chr", "start"]).withColumn("row_", F.explode(F.sequence(F.col("row_") - half, F.col("row_") + half)))
    summed = placed.groupBy("metacell_id", "chr", "row_").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    out = summed.join(rows, ["chr", "row_"]).where((F.col("row_") > half) & (F.col("row_") <= F.col("rows_") - half))
    return out.select("metacell_id", "chr", "start", (F.col("start") + step).alias("end"), "c", "t", percent_of("c", "t").alias("pct"))


def genome_grid(sizes: DataFrame, step: int) -> DataFrame:
    """chr, start, end of all bins of chromosomes (chr, size); the last one is cut off at the end."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(step).cast("bigint"))
    return sizes.select("chr", "size", F.explode(starts).alias("start")).select("chr", "start", F.least(F.col("start") + step, F.col("size")).alias("end"))


def fuzzy_gene_windows(calls: DataFrame, genes: DataFrame, step: int = 500, nmin: int = 2) -> DataFrame:
    """cell_id, gene_name, value: mean over the step windows that lie in a gene."""
    values = make_windows(calls, stepsize=step, nmin=nmin)
    own = first_genes(genes).select("chr", "start", "end", "gene_name")
    placed = values.withColumnsRenamed({"start": "pos", "end": "w_end"})
    held = range_join(placed, own).where(F.col("w_end") <= F.col("end"))
    return held.groupBy("cell_id", "gene_name").agg(F.avg("value").alias("value"))


def only(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose value is listed."""
    return df.join(listed.select(column).distinct(), column, "left_semi")


def without(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not listed."""
    return df.join(listed.select(column).distinct(), column, "left_anti")
