"""Command line: aggregate call tables into windows, convert old tables, delete parts, show the version."""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators.windows import aggregate_windows, custom_windows, only, sliding_windows, step_windows, without
from .sources.readers import read_windows_csv, write_aggregated


@dataclass(frozen=True)
class WindowSpec:
    """Uniform windows of a size and step, or those of a file."""

    name: str
    size: int | None = None
    step: int | None = None
    path: str | None = None


def parse_uniform(text: str) -> WindowSpec:
    """name=size:step, name=size, size:step or size; the default name is size, or size_by_step."""
    m = re.fullmatch(r"(?:([^=]+)=)?(\d+)(?::(\d+))?", text)
    if not m:
        raise ValueError(f"not a window specification: {text}")
    size, step = int(m[2]), int(m[3]) if m[3] else None
    if step and size % step:
        raise ValueError(f"{text}: the size must be a multiple of the step")
    return WindowSpec(m[1] or (f"{size}_by_{step}" if step else str(size)), size, step)


def parse_specs(uniform: list[str], files: list[str]) -> list[WindowSpec]:
    specs = [parse_uniform(u) for u in uniform]
    for f in files:
        name, _, path = f.rpartition("=")
        specs.append(WindowSpec(name or path.rsplit("/", 1)[-1].partition(".")[0], path=path))
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"a name is given twice: {names}")
    return specs


def aggregate(calls: DataFrame, spec: WindowSpec) -> DataFrame:
    """Pre-aggregated windows of one specification, by context (where there is one) and cell."""
    by = [c for c in ("context", "cell_id") if c in calls.columns]
    if spec.path:
        assigned = custom_windows(calls, read_windows_csv(calls.sparkSession, spec.path))
    elif spec.step:
        assigned = sliding_windows(calls, spec.size, spec.step)
    else:
        assigned = step_windows(calls, spec.size)
    return aggregate_windows(assigned, by).withColumn("name", F.lit(spec.name))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cytolake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    agg = sub.add_parser("agg", help="aggregate calls into windows")
    agg.add_argument("calls")
    agg.add_argument("out")
    agg.add_argument("-u", "--uniform", action="append", default=[])
    agg.add_argument("-w", "--windows", action="append", default=[])
    agg.add_argument("-c", "--context", action="append", default=[])
    agg.add_argument("--skipbc", help="file of barcodes to leave out")
    agg.add_argument("--requirebc", help="file of barcodes to keep")
    convert = sub.add_parser("convert", help="bring a table of the old layout (with pct) to the present one")
    convert.add_argument("source")
    convert.add_argument("out")
    convert.add_argument("--compression", default="zstd")
    delete = sub.add_parser("delete", help="write a table without a context, barcode or window set")
    delete.add_argument("level", choices=["context", "barcode", "dataset"])
    delete.add_argument("name")
    delete.add_argument("source")
    delete.add_argument("out")
    sub.add_parser("version", help="show the version")
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return
    spark = SparkSession.builder.appName("cytolake").getOrCreate()
    if a.command == "agg":
        calls = spark.read.parquet(a.calls)
        calls = calls.where(F.col("context").isin(a.context)) if a.context else calls
        for path, keep in ((a.requirebc, only), (a.skipbc, without)):
            if path:
                calls = keep(calls, spark.read.text(path).select(F.trim("value").alias("cell_id")), "cell_id")
        for spec in parse_specs(a.uniform, a.windows):
            write_aggregated(aggregate(calls, spec), a.out)
    elif a.command == "convert":
        df = spark.read.parquet(a.source)
        if "pct" not in df.columns:
            raise SystemExit("the table has the present layout already")
        df.drop("pct").write.option("compression", a.compression).partitionBy("context", "chr").parquet(a.out)
    else:
        column = {"context": "context", "barcode": "cell_id", "dataset": "name"}[a.level]
        spark.read.parquet(a.source).where(~F.col(column).eqNullSafe(a.name)).write.parquet(a.out)


if __name__ == "__main__":
    main()
