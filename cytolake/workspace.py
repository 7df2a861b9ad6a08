"""A container of named long tables, and the operations on all of them at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .operators.intervals import gene_ranges, windows_within
from .sources.readers import read_scale_cells, read_scale_samples


@dataclass
class Workspace:
    """paths, cells and genes are single tables; matrices, tracks, reductions, index and results are tables by name."""

    paths: DataFrame | None = None
    cells: DataFrame | None = None
    genes: DataFrame | None = None
    matrices: dict[str, DataFrame] = field(default_factory=dict)
    tracks: dict[str, DataFrame] = field(default_factory=dict)
    reductions: dict[str, DataFrame] = field(default_factory=dict)
    index: dict[str, DataFrame] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)

    def add_metadata(self, extra: DataFrame) -> "Workspace":
        return replace(self, cells=extra if self.cells is None else add_metadata(self.cells, extra))

    def add_prefix(self, prefix: str) -> "Workspace":
        """All cell ids with a prefix; paths keep their barcodes and get the prefix as a column."""
        named = lambda t: {k: with_prefix(d, prefix) for k, d in t.items()}
        paths = self.paths if self.paths is None else self.paths.withColumn("prefix", F.lit(prefix))
        return replace(self, paths=paths, cells=self.cells if self.cells is None else with_prefix(self.cells, prefix), matrices=named(self.matrices), reductions=named(self.reductions), index=named(self.index))

    def subset(self, cells: DataFrame) -> "Workspace":
        """Only the given cells; tables by group stay as they are."""
        cut = lambda d: subset_cells(d, cells)
        named = lambda t: {k: cut(d) for k, d in t.items()}
        return replace(self, paths=self.paths if self.paths is None else cut(self.paths), cells=self.cells if self.cells is None else cut(self.cells), matrices=named(self.matrices), reductions=named(self.reductions), index=named(self.index))

    def group_mean(self, name: str) -> DataFrame:
        return self.matrices[name].groupBy("feature").agg(F.avg("value").alias("value"))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("cell_id", F.concat(F.lit(prefix), F.col("cell_id").cast("string"))) if "cell_id" in df.columns else df


def subset_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(cells.select("cell_id").distinct(), "cell_id", "left_semi") if "cell_id" in df.columns else df


def add_metadata(cells: DataFrame, extra: DataFrame) -> DataFrame:
    """cells left-joined with extra; columns of both get the suffixes .x and .y. No common cell is an error."""
    if cells.join(extra, "cell_id", "left_semi").isEmpty():
        raise ValueError("no cell of the metadata is in the workspace")
    both = (set(cells.columns) & set(extra.columns)) - {"cell_id"}
    return cells.withColumnsRenamed({c: f"{c}.x" for c in both}).join(extra.withColumnsRenamed({c: f"{c}.y" for c in both}), "cell_id", "left")


def combine(parts: list[Workspace]) -> Workspace:
    """One workspace of several with distinct ids: tables are appended, indexes only under names that all have, genes of
    the first; reductions are left out."""

    def stack(frames):
        found = [f for f in frames if f is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None

    names = lambda get: sorted(set().union(*[get(p) for p in parts]))
    common = set.intersection(*[set(p.index) for p in parts]) if parts else set()
    return Workspace(
        paths=stack(p.paths for p in parts), cells=stack(p.cells for p in parts), genes=parts[0].genes,
        matrices={n: stack(p.matrices.get(n) for p in parts) for n in names(lambda p: p.matrices)},
        index={n: stack(p.index[n] for p in parts) for n in sorted(common)},
    )


def convert_legacy(old: dict[str, DataFrame]) -> Workspace:
    """A workspace from tables by their old names: paths to path, *tracks* to tracks, umap_x/y and tsne_x/y to reductions."""
    w = Workspace(paths=old.get("h5paths"), cells=old.get("metadata"), genes=old.get("ref"))
    if w.paths is not None:
        w.paths = w.paths.withColumnsRenamed({"paths": "path"})
    for name, df in old.items():
        if name not in ("h5paths", "metadata", "ref"):
            (w.tracks if "tracks" in name else w.matrices)[name] = df
    for kind in ("umap", "tsne"):
        if w.cells is not None and {f"{kind}_x", f"{kind}_y"} <= set(w.cells.columns):
            w.reductions[kind] = w.cells.select("cell_id", F.col(f"{kind}_x").alias("dim_x"), F.col(f"{kind}_y").alias("dim_y"))
            w.cells = w.cells.drop(f"{kind}_x", f"{kind}_y")
    return w


def upsert_track(track: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """track with the incoming windows (chr, start, end, grp, pct): of a window in both, what was there stays, or with
    force what comes."""
    both = track.withColumn("rank_", F.lit(1 if force else 0)).unionByName(incoming.withColumn("rank_", F.lit(0 if force else 1)), allowMissingColumns=True)
    keep = F.min("rank_").over(Window.partitionBy("chr", "start", "end"))
    return both.withColumn("keep_", keep).where("rank_ = keep_").drop("rank_", "keep_")


def missing_windows(wanted: DataFrame, track: DataFrame) -> DataFrame:
    """Windows (chr, start, end) that the track has not yet."""
    return wanted.join(track.select("chr", "start", "end").distinct(), ["chr", "start", "end"], "left_anti")


def populate_track(track: DataFrame | None, windows: DataFrame, genes: DataFrame | None = None, names: list[str] | None = None, regions: DataFrame | None = None, which: str = "pct", overhang: int = 5000, force: bool = False) -> DataFrame:
    """track with the windows (chr, start, end, grp and the column `which`) that lie in the ranges of the named genes, each
    widened by overhang, or in regions (chr, start, end).

    Windows that the track has are not read again, and stay as they are; with force they are read and replace what is
    there. Without a track the windows found are the track."""
    require_columns(windows, ["chr", "start", "end", "grp", which])
    if (names is None) == (regions is None):
        raise ValueError("give exactly one of names and regions")
    if names is not None and genes is None:
        raise ValueError("names need genes")
    ranges = regions if regions is not None else gene_ranges(genes.where(F.col("gene_name").isin(names)), overhang)
    wanted = windows_within(windows.select("chr", "start", "end").distinct(), ranges.select("chr", "start", "end"))
    if track is not None and not force:
        wanted = missing_windows(wanted, track)
    found = windows.join(wanted, ["chr", "start", "end"], "left_semi").select("chr", "start", "end", "grp", F.col(which).alias("pct"))
    return found if track is None else upsert_track(track, found, force)


def require_columns(df: DataFrame, names: list[str], kind: str = "table") -> DataFrame:
    """df, if it has the named columns; else an error that names those it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the {kind} lacks the columns {missing}; it has {df.columns}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def reduction_of(workspace: Workspace, name: str) -> DataFrame:
    """A reduction by name, or an error that lists those there are."""
    if name not in workspace.reductions:
        raise ValueError(f"no reduction {name}; there are {sorted(workspace.reductions)}")
    return require_columns(workspace.reductions[name], ["cell_id"], "reduction")


def read_scale_workspace(spark: SparkSession, directory: str, matrices: list[str] = (), zeros: bool = True) -> Workspace:
    """A workspace of the samples of a directory: passing cells, the paths of their calls, and matrices by name."""
    cells = read_scale_cells(spark, directory)
    paths = cells.select(F.col("cell_id").alias("barcode"), "path")
    return Workspace(paths=paths, cells=cells.drop("path"), matrices={m: read_scale_samples(spark, directory, m, zeros) for m in matrices})
