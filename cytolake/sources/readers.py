"""Readers and writers of the field's file formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CELL_INFO


def read_calls(spark: SparkSession, path: str, context: str | None = None, chromosomes: list[str] | None = None) -> DataFrame:
    """Base-level calls kept as Parquet partitioned by context and chr: both filters prune partitions."""
    df = spark.read.parquet(path)
    df = df.where(F.col("context") == context) if context else df
    return df.where(F.col("chr").isin(chromosomes)) if chromosomes else df


def write_calls(calls: DataFrame, path: str) -> None:
    """Partitioned by context and chr, sorted by cell and position, so that row-group statistics serve point ranges."""
    calls.repartition("context", "chr", F.floor(F.col("pos") / 10_000_000)).sortWithinPartitions("cell_id", "pos").write.mode("overwrite").partitionBy("context", "chr").parquet(path)


def read_aggregated(spark: SparkSession, path: str, name: str, context: str | None = None) -> DataFrame:
    """Pre-aggregated windows of one name (and context) from a table partitioned by them: other partitions are not read."""
    df = spark.read.parquet(path).where(F.col("name") == name)
    return df.where(F.col("context") == context) if context else df


def write_aggregated(windows: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by name and, where there is one, context."""
    windows.write.mode(mode).partitionBy("name", *[c for c in ("context",) if c in windows.columns]).parquet(path)


def saved(df: DataFrame, path: str | None, by: str | None = "chr") -> DataFrame:
    """df written to path, by chromosome, and read back: a checkpoint to go on from. Without a path df itself."""
    if path is None:
        return df
    keys = [by] if by and by in df.columns else []
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def read_h5_calls(spark: SparkSession, files: DataFrame, context: str = "CG") -> DataFrame:
    """cell_id, chr, pos, c, t from HDF5 files (barcode, path, optional prefix), where h5py is installed."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py on the driver and the executors") from e

    def scan(batches):
        import h5py
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                with h5py.File(r.path, "r") as f:
                    d = pd.DataFrame.from_records(f[f"{context}/{r.barcode}/1"][:])
                d["chr"] = d["chr"].str.decode("ascii") if d["chr"].dtype == object else d["chr"]
                yield pd.DataFrame({"cell_id": r.cell_id, "chr": d["chr"], "pos": d["pos"].astype("int64"), "c": d["c"].astype("int64"), "t": d["t"].astype("int64")})

    prefix = F.coalesce(F.col("prefix"), F.lit("")) if "prefix" in files.columns else F.lit("")
    return files.select("barcode", "path", F.concat(prefix, "barcode").alias("cell_id")).mapInPandas(scan, "cell_id string, chr string, pos bigint, c bigint, t bigint")


def plain_barcode(barcode: Column) -> Column:
    """A barcode without what follows its first dot."""
    return F.regexp_replace(barcode, r"\..*$", "")


def read_cell_info(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV of 6 or 10 columns, or of any number up to 10 of them in order."""
    n = len(spark.read.csv(path, sep="\t").columns)
    if n > len(CELL_INFO):
        raise ValueError(f"{n} columns; at most {len(CELL_INFO)} are known")
    return spark.read.csv(path, sep="\t", schema=", ".join(CELL_INFO[:n]))


def read_annotation(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """cell_id and the named columns (one, annot, by default) of a headerless TSV; workspace.add_metadata() joins them."""
    names = names or ("annot",)
    found = len(spark.read.csv(path, sep="\t").columns)
    if found != 1 + len(names):
        raise ValueError(f"{found} columns; cell_id and {len(names)} more are named")
    return spark.read.csv(path, sep="\t", schema=", ".join(["cell_id string", *(f"`{n}` string" for n in names)]))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df with its rows' numbers from 1 in the order of its partitions: each counts its own rows and begins where those
    before it end, so that no task sees all rows."""
    own = df.withColumn("id_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("id_", 33))
    counts = own.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    return own.join(before, "part_").withColumn(column, F.col("id_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before_") + 1).drop("id_", "part_", "before_")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end of a headerless BED file; more columns than three are an error. Duplicate rows count once."""
    if len(spark.read.csv(path, sep="\t").columns) > 3:
        raise ValueError("a BED file of exactly three columns is needed")
    return spark.read.csv(path, sep="\t", schema="chr string, start bigint, end bigint").distinct()


def read_windows_csv(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end by the header's names."""
    df = spark.read.csv(path, header=True)
    missing = {"chr", "start", "end"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.select("chr", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The quoted value of a key of GTF attributes, or null."""
    return F.nullif(F.regexp_extract(attributes, rf'(?:^|;\s*){key} "([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("gene_name", "exon_number", "gene_type")) -> DataFrame:
    """chr, source, type, start, end, strand, the attributes, location (chr_start_end), and ord, which follows the file."""
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("#"))
    parts = raw.withColumn("p", F.split("value", "\t"))
    cols = [F.get("p", F.lit(i)) for i in range(9)]
    base = parts.select(cols[0].alias("chr"), cols[1].alias("source"), cols[2].alias("type"), cols[3].cast("bigint").alias("start"), cols[4].cast("bigint").alias("end"), cols[6].alias("strand"), *[gtf_attribute(cols[8], a).alias(a) for a in attributes], "ord")
    return base.withColumn("location", F.concat_ws("_", "chr", "start", "end"))


def read_scale_matrix(spark: SparkSession, mtx: str, features: str, cells: str) -> DataFrame:
    """feature, cell_id, value of one sample: MatrixMarket entries joined to their features' and passing cells' names.

    The first line that is no comment states the size; it is left out by its place, not by what it says. Entries that
    the file leaves out are 0 within a sample; they stay left out here, see read_scale_samples()."""
    lines = spark.read.text(mtx).withColumn("o", F.monotonically_increasing_id()).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    header = lines.agg(F.min("o")).first()[0]
    p = F.split(F.trim("value"), r"\s+")
    entries = lines.where(F.col("o") > header).select(p[0].cast("bigint").alias("i"), p[1].cast("bigint").alias("j"), p[2].cast("double").alias("value"))
    names = numbered(spark.read.csv(features, sep="\t").select(F.col("_c0").alias("feature")), "i")
    barcodes = numbered(spark.read.csv(cells, header=True).where(F.col("pass") == "pass").select("cell_id"), "j")
    return entries.join(names, "i").join(barcodes, "j").select("feature", "cell_id", "value")


def scale_samples(spark: SparkSession, directory: str) -> list[str]:
    """The samples of a directory: those that have a *.allCells.csv file."""
    names = spark.read.format("binaryFile").load(f"{directory}/*.allCells.csv").select("path")  # the column of contents is not read
    return sorted(r[0] for r in names.select(F.regexp_extract("path", r"([^/]+)\.allCells\.csv$", 1)).collect())


def read_scale_samples(spark: SparkSession, directory: str, matrix: str, zeros: bool = True) -> DataFrame:
    """feature, cell_id, value of a matrix over all samples of a directory, one below the other.

    A feature that a sample's list has is 0 in its cells where the file has no entry (with zeros); one that the list
    lacks is missing in them."""
    kind = next((k for k in ("CG", "CH") if k in matrix), None)
    if kind is None:
        raise ValueError(f"neither CG nor CH in the matrix's name: {matrix}")
    out = None
    for sample in scale_samples(spark, directory):
        where, cells = f"{directory}/genome_bin_matrix/{sample}", f"{directory}/{sample}.allCells.csv"
        own = read_scale_matrix(spark, f"{where}.{matrix}.mtx.gz", f"{where}.{kind}.features.tsv", cells)
        if zeros:  # dense, as a sample's matrix is
            names = spark.read.csv(f"{where}.{kind}.features.tsv", sep="\t").select(F.col("_c0").alias("feature"))
            passing = spark.read.csv(cells, header=True).where(F.col("pass") == "pass").select("cell_id")
            own = names.crossJoin(passing).join(own, ["feature", "cell_id"], "left").select("feature", "cell_id", F.coalesce("value", F.lit(0.0)).alias("value"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError(f"no *.allCells.csv in {directory}")
    return out


def read_scale_cells(spark: SparkSession, directory: str) -> DataFrame:
    """The passing cells of all samples of a directory, with all columns and path, where their calls lie."""
    df = spark.read.csv(f"{directory}/*.allCells.csv", header=True).withColumn("sample", F.regexp_extract(F.input_file_name(), r"([^/]+)\.allCells\.csv$", 1))
    path = F.concat(F.lit(f"{directory}/methylation_coverage/amethyst/"), F.col("sample"), F.lit("/"), F.col("sample"), F.lit("."), F.col("tgmt_well"), F.lit("_cov.h5"))
    return df.where(F.col("pass") == "pass").withColumn("path", path)


def scale_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """cell_id, path of the passing cells of all *.allCells.csv files of a directory."""
    df = spark.read.csv(pattern, header=True).withColumn("dir_", F.regexp_replace(F.input_file_name(), r"/[^/]*$", ""))
    return df.where(F.col("pass") == "pass").select("cell_id", F.concat("dir_", F.lit("/"), "tgmt_well", F.lit(".h5")).alias("path"))


#: Marker genes of blood cells. Other lists are given as files, one gene a line.
PBMC_MARKERS = ["Spi1", "Cd19", "Cd2", "Cd6", "Cd8a", "Cd4", "Csf1r", "S100a8", "Gata1", "Cd79a", "Cd3g", "Elane", "Mpo", "Itgam", "Retnlg", "Ly6g", "S100a8", "Mpeg1", "Fn1", "Irf8", "Lyz2", "Cd74", "Rora", "Gzmk", "Cd3e", "Cd3d", "Meis1", "Kir2dl4", "Klrb1"]


def fetch_markers(spark: SparkSession, species: str, path: str | None = None) -> DataFrame:
    """gene_name of the marker list: the blood list, or the file's; in capitals for human."""
    genes = spark.read.text(path).select(F.trim("value").alias("gene_name")) if path else spark.createDataFrame([(g,) for g in PBMC_MARKERS], "gene_name string")
    return genes.select(F.upper("gene_name").alias("gene_name")) if species == "human" else genes


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").coalesce(1).write.mode("overwrite").text(path)


def sequence_lines(fasta: DataFrame, borrow: int) -> DataFrame:
    """chr, before, tail, s of the sequence lines of FASTA (ord, value): where a line starts in its sequence, and the
    borrow bases before it (N where there are none).

    ord is as read_fasta() gives it: its high bits number the file splits. Lines are placed within their split; one row
    for each split then says how its first lines go on from the splits before, however few bases these hold. With a
    column file no sequence goes on from one file to the next."""
    split = Window.partitionBy("split").orderBy("ord")
    head = F.col("value").startswith(">")
    lines = fasta if "file" in fasta.columns else fasta.withColumn("file", F.lit(""))
    lines = lines.withColumn("split", F.shiftright("ord", 33)).withColumn("head", head.cast("int")).withColumn("s", F.when(head, "").otherwise(F.upper("value")))
    lines = lines.withColumn("part", F.sum("head").over(split)).withColumn("name", F.last(F.when(head, F.regexp_extract("value", r"^>(\S*)", 1)), True).over(split))
    part = Window.partitionBy("split", "part").orderBy("ord")
    lines = lines.withColumn("here", F.coalesce(F.sum(F.length("s")).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = F.concat_ws("", *[F.lag("s", i).over(part) for i in range(borrow, 0, -1)])
    lines = lines.withColumn("near", near).where((F.length("s") > 0) | (F.col("head") == 1))
    ends = lines.groupBy("split").agg(F.first("file").alias("file"), F.max("part").alias("parts"), F.max_by(F.struct("name", (F.col("here") + F.length("s")).alias("size"), F.concat("near", "s").alias("last")), "ord").alias("e"))
    order = Window.orderBy("split")
    starts = (F.col("parts") > 0) | ~F.col("file").eqNullSafe(F.lag("file").over(order))
    run = Window.partitionBy("run").orderBy("split")
    ends = ends.withColumn("run", F.sum(starts.cast("int")).over(order)).withColumn("sum_", F.sum("e.size").over(run)).withColumn("end_", F.array_join(F.collect_list("e.last").over(run), ""))
    carried = lambda c: F.when(F.lag("file").over(order).eqNullSafe(F.col("file")), c)
    name = F.last("e.name", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("split").alias("split_"), carried(F.lag("sum_").over(order)).alias("carry"), carried(F.lag("end_").over(order)).alias("carried"), carried(name).alias("carry_name"))
    first = F.col("part") == 0
    placed = lines.where("head = 0").join(ends, F.col("split") == F.col("split_"))
    tail = F.concat(F.lit("N" * borrow), F.when(first, F.coalesce("carried", F.lit(""))).otherwise(""), "near")
    return placed.select(
        F.when(first, F.col("carry_name")).otherwise(F.col("name")).alias("chr"), (F.col("here") + F.when(first, F.coalesce("carry", F.lit(0))).otherwise(0)).alias("before"),
        F.substring(tail, -borrow, borrow).alias("tail"), "s",
    )


def scan_motifs(fasta: DataFrame, kind: str = "CG") -> DataFrame:
    """chr, pos, motif, strand of the CG (or CHN) sites of FASTA lines (ord, value), on both strands, across line breaks."""
    k = 2 if kind == "CG" else 3
    lines = sequence_lines(fasta, k - 1).withColumn("t", F.concat("tail", "s"))
    grams = lines.select("chr", "before", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substr("t", i, F.lit(k)))).alias("i", "g"))
    end = (F.col("before") + F.col("i") + 1).cast("bigint")
    if kind == "CG":
        hit = grams.where("g = 'CG'").select("chr", "g", F.explode(F.array(F.struct((end - 1).alias("pos"), F.lit("+").alias("strand")), F.struct(end.alias("pos"), F.lit("-").alias("strand")))).alias("x"))
        return hit.select("chr", "x.pos", F.col("g").alias("motif"), "x.strand")
    forward = grams.where(F.col("g").rlike("^C[^G]")).select("chr", (end - 2).alias("pos"), F.col("g").alias("motif"), F.lit("+").alias("strand"))
    back = grams.where(F.col("g").rlike(".[^C]G$")).select("chr", end.alias("pos"), F.translate(F.reverse("g"), "ATGC", "TACG").alias("motif"), F.lit("-").alias("strand"))
    return forward.unionByName(back)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ord, file, value of the lines of FASTA files; .gz is read as well."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.input_file_name().alias("file"), "value")
