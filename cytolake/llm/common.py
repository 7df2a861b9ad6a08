"""Shared helpers: materialising in the shared folder, Arrow batches, bounded samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts of this package define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes that a task gathers before it writes them: wide columns would fill the default of 128 MB in every task.
ROW_GROUP = 16 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """Rows of wide columns go to Python workers in batches of so many rows and bytes, by what is run inside the block."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all tasks run on
    this machine (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='cytolake-shared-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, label: str, **write) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, **write)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run):
    """run, a function over batches, which gives memory that it freed back to the system when its task ends: workers are
    used again by other steps, and what they hold on to counts."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text) -> F.Column:
    """Words of a text (null: 0), without materialising them: each word and the white space behind it becomes one x."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(flat, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("long")


def bounded_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each slice holds at most max_bytes of the column, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def most_frequent(counted: DataFrame, limit: int, label: str) -> DataFrame:
    """The rows of counted (column n) with the highest counts, as many as are surely no more than limit.

    A histogram of counts over a fixed number of steps gives the bound, so nothing is sorted and the driver sees only
    the histogram; rows of one step are taken all or none. counted is written once and read back."""
    kept = materialize(counted, label)
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    held, bound = 0, None
    for r in sorted(kept.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > limit:
            break
        bound = r["step"]
    return kept.where(step >= bound) if bound is not None else kept.limit(0)


def copy_key(words: list[str]) -> int:
    """The same for near copies, mostly: the smallest checksum of three words in a row, over the whole text."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))), default=0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_bytes: int = 256 << 20) -> list[tuple[str, int]]:
    """At most limit labelled texts with crc32(doc_id) mod 5 != 0, of max_bytes in all, chosen by a hash of doc_id; both
    bounds are for the driver. A text that would pass max_bytes is left out, and shorter ones behind it may still come.

    Rows without a doc_id, label or usable text are skipped (null text counts as empty). Of contradictory labels of an id
    1 counts; of several texts of an id the first in order."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id").agg(F.max(label).alias("label_"))
    )
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 1.2 * (limit + 1000) / max(1, usable.count()))  # only so many come to be sorted
    picked = usable.where(order < int(share * (1 << 30))).orderBy(order, "doc_id").limit(limit)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label_").alias("y")).withColumn("size", F.octet_length("text"))
    rows = materialize(one, f"sample-{label}")
    kept, held = [], 0
    for r in rows.select("doc_id", "size").orderBy(order, "doc_id").collect():
        if held + r["size"] <= max_bytes:
            held += r["size"]
            kept.append(r.doc_id)
    chosen = rows.where(F.col("doc_id").isin(kept)) if len(kept) < rows.count() else rows
    return [(r.text, int(r.y)) for r in sorted(chosen.select("doc_id", "text", "y").collect(), key=lambda r: r.doc_id)]
