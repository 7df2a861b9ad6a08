"""Doublet detection: simulated pairs, a random forest, scores."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def simulated(matrix: DataFrame, cells: DataFrame, fraction: float = 0.25, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The matrix with artificial doublets, and cell_id, artificial of all its cells.

    Pairs are drawn with replacement by hashes of seed and number; where one cell has no value the other's is kept half
    of the time, where both have one it is their mean."""
    ids = cells.select(F.col("cell_id").cast("string").alias("cell_id")).distinct()
    n = ids.count()
    ranked = ids.withColumn("r_", F.row_number().over(Window.orderBy("cell_id")) - 1)
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(max(n, 1)))
    pairs = cells.sparkSession.range(-(-int(n * fraction * 1000) // 1000)).select("id", draw("a").alias("x"), draw("b").alias("y"))
    pairs = pairs.join(ranked.withColumnsRenamed({"cell_id": "a", "r_": "x"}), "x").join(ranked.withColumnsRenamed({"cell_id": "b", "r_": "y"}), "y").select(F.concat(F.lit("doublet_"), F.col("id").cast("string")).alias("d"), "a", "b")
    m = matrix.select("feature", F.col("cell_id").cast("string").alias("cell_id"), "value")
    left = pairs.join(m, pairs.a == m.cell_id).select("d", "feature", F.col("value").alias("va"))
    right = pairs.join(m, pairs.b == m.cell_id).select("d", "feature", F.col("value").alias("vb"))
    coin = F.pmod(F.xxhash64(F.lit(seed), "d", "feature"), F.lit(2)) == 0
    mixed = left.join(right, ["d", "feature"], "full").select(
        "feature", F.col("d").alias("cell_id"), F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), (F.col("va") + F.col("vb")) / 2).when(coin, F.coalesce("va", "vb")).alias("value"),
    )
    flags = ids.withColumn("artificial", F.lit(False)).unionByName(pairs.select(F.col("d").alias("cell_id"), F.lit(True).alias("artificial")))
    return m.unionByName(mixed.where("value is not null")), flags


def fit_model(embedding: DataFrame, flags: DataFrame, trees: int = 100, seed: int = 1) -> tuple[RandomForestClassificationModel, DataFrame]:
    """A random forest on 80 % of each class, and cell_id, artificial, score of the others."""
    data = embedding.join(flags, "cell_id").select("cell_id", array_to_vector("vec").alias("features"), F.col("artificial").cast("double").alias("label"))
    part = F.percent_rank().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id"))
    split = data.withColumn("part_", part)
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(split.where("part_ <= 0.8"))
    return model, _scored(model, split.where("part_ > 0.8")).select("cell_id", (F.col("label") == 1).alias("artificial"), "score")


def _scored(model, data: DataFrame) -> DataFrame:
    return model.transform(data).withColumn("score", vector_to_array("probability")[1])


def scores(model: RandomForestClassificationModel, embedding: DataFrame) -> DataFrame:
    """cell_id, score: the probability of being a doublet."""
    return _scored(model, embedding.select("cell_id", array_to_vector("vec").alias("features"))).select("cell_id", "score")


def add_scores(cells: DataFrame, scored: DataFrame) -> DataFrame:
    return cells.join(scored.select("cell_id", F.col("score").alias("doublet_score")), "cell_id", "left")
