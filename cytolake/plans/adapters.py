"""Genomic views over the relational test tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, where a query writes a table to read it back."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # on one machine only: elsewhere executors would each write to a disk of their own
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cytolake-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-level calls: cell_id, chr, pos, c, t."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("int") % 4
    meth = F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_suppkey").alias("cell_id"),
        F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chr"),
        (F.col("l_orderkey") * 10 + F.col("l_partkey") % 10).alias("pos"),
        F.when(meth, n).otherwise(0).cast("bigint").alias("c"),
        F.when(~meth, n).otherwise(0).cast("bigint").alias("t"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell metadata: cell_id, grp, batch, cov."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("grp"), (F.col("n_nationkey") % 2).alias("batch"), (F.col("s_acctbal") + 1000).alias("cov"))
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene reference with duplicate names; ord is the file order."""
    p = table(spark, sf_dir, "part")
    start = (F.col("p_partkey") * 73) % 15000
    return p.select(
        F.concat(F.lit("chr"), (F.col("p_partkey") % 7 + 1).cast("string")).alias("chr"),
        start.alias("start"), (start + F.col("p_size") * 100).alias("end"),
        F.concat_ws("_", "p_brand", "p_type").alias("gene_name"), F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def rates(calls_: DataFrame) -> DataFrame:
    """Each cell's global methylation rate g, from sites."""
    m, u = F.count_if(F.col("c") != 0), F.count_if(F.col("t") != 0)
    return calls_.groupBy("cell_id").agg(F.try_divide(m.cast("double"), (m + u).cast("double")).alias("g"))


#: The same views for the SQL side.
SQL = {
    "calls": """calls AS (SELECT l_suppkey AS cell_id, 'chr' || l_linenumber AS chr, (l_orderkey * 10 + l_partkey % 10)::BIGINT AS pos,
  (CASE WHEN l_returnflag = 'R' THEN l_quantity::INT % 4 ELSE 0 END)::BIGINT AS c,
  (CASE WHEN l_returnflag <> 'R' THEN l_quantity::INT % 4 ELSE 0 END)::BIGINT AS t FROM lineitem)""",
    "cells": """cells AS (SELECT s_suppkey AS cell_id, r_name AS grp, n_nationkey % 2 AS batch, s_acctbal + 1000 AS cov
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "genes": """genes AS (SELECT 'chr' || (p_partkey % 7 + 1) AS chr, ((p_partkey * 73) % 15000)::BIGINT AS "start",
  ((p_partkey * 73) % 15000 + p_size * 100)::BIGINT AS "end", p_brand || '_' || p_type AS gene_name, p_partkey AS ord,
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)""",
    "rates": """rates AS (SELECT cell_id, count(*) FILTER (c <> 0) / nullif((count(*) FILTER (c <> 0) + count(*) FILTER (t <> 0))::DOUBLE, 0) AS g FROM calls GROUP BY cell_id)""",
}
