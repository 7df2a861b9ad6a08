"""Range, overlap and containment joins, and interval unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def range_join(points: DataFrame, regions: DataFrame, closed: bool = True, bin_width: int = 10_000) -> DataFrame:
    """Each point with each region of its chr that holds it: start <= pos <= end, or < end when not closed.

    Regions are spread over the bins that they touch, so the join is an equi-join on (chr, bin) with a residual
    condition: Catalyst broadcasts the regions if they are small and hashes or sorts both sides if not. Every point has
    one bin, so no pair comes twice."""
    p = points.withColumn("bin_", F.floor(F.col("pos") / bin_width))
    r = regions.withColumn("bin_", _bins(F.col("start"), F.col("end"), bin_width))
    upper = (p["pos"] <= r["end"]) if closed else (p["pos"] < r["end"])
    joined = p.join(r, (p["chr"] == r["chr"]) & (p["bin_"] == r["bin_"]) & (p["pos"] >= r["start"]) & upper)
    return joined.drop(r["chr"], r["bin_"], p["bin_"])


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", bin_width: int = 100_000) -> DataFrame:
    """Rows of a and b of the same chr that overlap, ends included; columns of b but chr get the prefix b_.

    Both sides stand in every bin that they touch; a pair is kept only in the bin where it first meets. how: inner, left
    (rows of a without a partner once, with nulls), or left_semi."""
    b = b.select(F.col("chr").alias("b_chr"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "chr"])
    key = a.withColumn("row_", F.monotonically_increasing_id()) if how != "inner" else a
    x = key.withColumn("bin_", _bins(F.col("start"), F.col("end"), bin_width))
    y = b.withColumn("b_bin_", _bins(F.col("b_start"), F.col("b_end"), bin_width))
    meets = (F.col("start") <= F.col("b_end")) & (F.col("end") >= F.col("b_start"))
    first = F.col("bin_") == F.greatest(F.floor(F.col("start") / bin_width), F.floor(F.col("b_start") / bin_width))
    pairs = x.join(y, (F.col("chr") == F.col("b_chr")) & (F.col("bin_") == F.col("b_bin_")) & meets & first).drop("bin_", "b_bin_", "b_chr")
    if how == "inner":
        return pairs
    if how == "left_semi":
        return pairs.dropDuplicates(["row_"]).select(*a.columns)
    alone = a.join(pairs.select(*a.columns).distinct(), [a[c].eqNullSafe(pairs[c]) for c in a.columns], "left_anti")
    return pairs.drop("row_").unionByName(alone, allowMissingColumns=True)


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1, tile: int | None = None) -> DataFrame:
    """df with island_start and island_end: the union of intervals of the same keys that overlap or are at most gap apart.

    One sweep for each group of keys; with tile, where a group may be a whole chromosome, within tiles of that width (by
    start): one row for each tile then says how far what began before it reaches, and which islands go on. So a
    chromosome is as many tasks as it has tiles with intervals; df is read three times for it."""
    tiled = df.withColumn("tile_", F.floor(F.col(start) / tile) if tile else F.lit(0))
    order = Window.partitionBy(*keys, "tile_").orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = tiled.withColumn("new_", (reach.isNull() | (F.col(start) > reach + gap)).cast("int"))
    placed = placed.withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "tile_", "island_")
    placed = placed.withColumn("s_", F.min(start).over(whole)).withColumn("e_", F.max(end).over(whole)).drop("new_", "island_")
    if not tile:
        return placed.select(*df.columns, F.col("s_").alias("island_start"), F.col("e_").alias("island_end"))
    # how far the intervals of the tiles before reach, and where the island begins that reaches so far
    tiles = placed.groupBy(*keys, "tile_").agg(F.max(F.struct("e_", "s_")).alias("last_"))
    by = Window.partitionBy(*keys).orderBy("tile_")
    tiles = tiles.withColumn("reach_", F.max("last_.e_").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("reach_").isNull() | (F.col("last_.s_") > F.col("reach_") + gap)
    tiles = tiles.withColumn("from_", F.last(F.when(fresh, F.col("last_.s_")), True).over(by))
    tiles = tiles.withColumn("before_", F.lag("from_").over(by))
    own = lambda d, names: [F.col(n).alias(f"{n}_k_") if n in names else F.col(n) for n in d.columns]
    same = lambda names: reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_k_")) for n in names])
    tiles = tiles.select("*", F.col("last_.s_").alias("last_s_")).drop("last_")
    joined = placed.join(tiles.select(*own(tiles, [*keys, "tile_"])), same([*keys, "tile_"]))
    goes_on = F.coalesce(F.col("s_") <= F.col("reach_") + gap, F.lit(False))
    island = F.when(goes_on, F.col("before_")).when(F.col("s_") == F.col("last_s_"), F.col("from_")).otherwise(F.col("s_"))
    joined = joined.select(*df.columns, island.alias("island_start"), "e_")
    ends = joined.groupBy(*keys, "island_start").agg(F.max("e_").alias("island_end"))
    return joined.join(ends.select(*own(ends, [*keys, "island_start"])), same([*keys, "island_start"])).select(*df.columns, "island_start", "island_end")


def merged(df: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """The islands themselves: keys, start, end."""
    return islands(df, keys, gap=gap, tile=10_000_000).groupBy(*keys, F.col("island_start").alias("start"), F.col("island_end").alias("end")).agg(F.count("*").alias("n")).drop("n")


def parse_regions(df: DataFrame, column: str = "region") -> DataFrame:
    """chr, start, end of keys like chr_start_end; rows that have not three parts raise an error."""
    parts = F.split(column, "_")
    ok = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not chr_start_end: "), F.col(column))))
    return df.select(ok.alias("p_")).select(F.col("p_")[0].alias("chr"), F.col("p_")[1].cast("bigint").alias("start"), F.col("p_")[2].cast("bigint").alias("end"))


def gene_coords(genes: DataFrame, name: str) -> DataFrame:
    """location (chr_start_end) of the rows of a gene."""
    rows = genes.where(F.col("type") == "gene") if "type" in genes.columns else genes
    return rows.where(F.col("gene_name") == name).select(F.concat_ws("_", "chr", "start", "end").alias("location"))


def longest_genes(genes: DataFrame) -> DataFrame:
    """One row per gene_name: the longest; ties to the first in file order."""
    order = Window.partitionBy("gene_name").orderBy(F.desc(F.col("end") - F.col("start")), "ord")
    return genes.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def first_genes(genes: DataFrame) -> DataFrame:
    """One row per gene_name: the first in file order."""
    order = Window.partitionBy("gene_name").orderBy("ord")
    return genes.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def gene_ranges(genes: DataFrame, overhang: int = 5000) -> DataFrame:
    """chr, start, end, gene_name of the longest row of each gene, widened and cut off at 0."""
    return longest_genes(genes).select("chr", F.greatest(F.lit(0).cast("bigint"), F.col("start") - overhang).alias("start"), (F.col("end") + overhang).alias("end"), "gene_name")


def promoters(genes: DataFrame, reach: int = 1500) -> DataFrame:
    """genes with start and end around the transcription start: start on the + strand, else end."""
    tss = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    return genes.withColumn("tss_", tss).withColumn("start", F.col("tss_") - reach).withColumn("end", F.col("tss_") + reach).drop("tss_")


def windows_within(windows: DataFrame, ranges: DataFrame, bin_width: int = 100_000) -> DataFrame:
    """Distinct windows that lie wholly in a range of their chr."""
    r = ranges.select(F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).withColumn("r_bin", _bins(F.col("r_start"), F.col("r_end"), bin_width))
    w = windows.withColumn("bin_", F.floor(F.col("start") / bin_width))
    held = (F.col("chr") == F.col("r_chr")) & (F.col("bin_") == F.col("r_bin")) & (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    return w.join(r, held, "left_semi").drop("bin_").distinct()


def coding_ranges(genes: DataFrame, promoter: bool = False, reach: int = 1500) -> DataFrame:
    """Longest row of each protein-coding gene, or its promoter (then without chrM)."""
    coding = genes.where(F.col("gene_type") == "protein_coding") if "gene_type" in genes.columns else genes
    long = longest_genes(coding)
    return promoters(long.where("chr <> 'chrM'"), reach) if promoter else long


def chromosome_index(calls: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """cell_id, chr, start, count: where each chromosome's rows begin in a cell's rows, and how many they are.

    Rows are only counted; starts are running sums over a cell's chromosomes. keep: chromosomes to index; by default all
    but those whose name matches _, EBV or M."""
    counts = calls.groupBy("cell_id", "chr").agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("cell_id").orderBy("chr")) - F.col("count")
    numbered = counts.withColumn("start", before + 1)
    chosen = numbered.where(F.col("chr").isin(keep)) if keep else numbered.where(~F.col("chr").rlike("_|EBV|M"))
    return chosen.select("cell_id", "chr", "start", "count")


def gene_index(calls: DataFrame, genes: DataFrame, order: str = "pos", bin_width: int = 100_000) -> DataFrame:
    """cell_id, gene_name, first, count: where each gene's rows begin in a cell's rows, and how many they are.

    Rows are numbered within a cell's bin only; a running sum over the bins says how many come before."""
    binned = calls.withColumn("tile_", F.floor(F.col("pos") / bin_width))
    by = Window.partitionBy("cell_id", "chr", "tile_").orderBy(order, "c", "t")
    placed = range_join(binned.withColumn("in_bin_", F.row_number().over(by)), genes.select("chr", "start", "end", "gene_name"))
    found = placed.groupBy("cell_id", "gene_name").agg(F.min(F.struct("chr", "tile_", "in_bin_")).alias("f_"), F.count("*").alias("count"))
    counts = binned.groupBy("cell_id", "chr", "tile_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.sum("n_").over(Window.partitionBy("cell_id").orderBy("chr", "tile_")) - F.col("n_")).select("cell_id", "chr", "tile_", "before_")
    flat = found.select("cell_id", "gene_name", "count", "f_.*")
    return flat.join(before, ["cell_id", "chr", "tile_"]).select("cell_id", "gene_name", (F.col("before_") + F.col("in_bin_")).alias("first"), "count")


def gene_calls(calls: DataFrame, genes: DataFrame, name: str, cells: DataFrame | None = None) -> DataFrame:
    """Calls in the ranges of one gene, of all cells or of those listed."""
    own = calls if cells is None else calls.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    return range_join(own, genes.where(F.col("gene_name") == name).select("chr", "start", "end")).select(*calls.columns).distinct()
