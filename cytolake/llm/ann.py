"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are rotated at random and only the signs are kept, packed to bits, with two correction scalars: the vector's
length, and the inner product of its unit vector with its code. A query's inner product with the code, corrected,
estimates the true inner product; the error is bounded by the code's angle. Only vectors whose upper bound reaches a
query's k-th best known score are compared exactly, in double precision.

1. Index: every vector's code; the code's leading bits name its cell, and cells are cut into blocks of bounded size.
2. Each block is described (centre, spread, radius), and the queries in it find their k nearest there.
3. Queries go to the other blocks whose bound reaches that score, dealt to as many tasks as a block's queries need.
4. Blocks are searched by codes, and the best of all blocks are a query's neighbours.
Vectors and queries move between executors only; the driver sees the blocks' descriptions and histograms of cells.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Vectors of a block: more where there are more vectors, so that blocks stay few; leading bits that name a cell, at most.
MIN_BLOCK, MAX_BLOCK, CELL_BITS = 1 << 13, 1 << 16, 12
#: Queries that one task compares with a block, and rows (histogram of cells) that may be told to all tasks.
TASK_QUERIES, TOLD_ROWS = 1 << 16, 1 << 18
#: Vectors and queries that meet in one product of matrices.
SLICE, STEP = 4096, 512
#: Width of the bounds in standard deviations: of a vector's estimate, and of a block's vectors around its centre.
EPSILON, BLOCK_EPSILON = 2.2, 5.0


@lru_cache(4)
def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed signs and correction scalars of a block of vectors."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, along: np.ndarray, dims: int):
        self.bits, self.norm, self.along, self.dims = bits, norm, along, dims

    @classmethod
    def of(cls, vectors: np.ndarray) -> "Codes":
        dims = vectors.shape[1]
        size = np.abs(vectors).max(1)  # so that no square over- or underflows
        unit = vectors / size[:, None]
        length = np.sqrt((unit**2).sum(1))
        turned = (unit / length[:, None]) @ rotation(dims)
        # of the unit vector with its code, a vector of +-1/sqrt(dims)
        return cls(np.packbits(turned > 0, axis=1), length * size, np.abs(turned).sum(1) / np.sqrt(dims), dims)

    def part(self, rows) -> "Codes":
        return Codes(self.bits[rows], self.norm[rows], self.along[rows], self.dims)

    def estimates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors), and half the width of their bounds."""
        signs = np.unpackbits(self.bits, axis=1, count=self.dims).astype(np.float32) * 2 - 1
        q = (queries @ rotation(self.dims)).astype(np.float32)
        estimate = (q @ signs.T) * (self.norm / self.along / np.sqrt(self.dims)).astype(np.float32)
        spread = np.sqrt(np.maximum(1 - self.along**2, 0)) / self.along / np.sqrt(max(1, self.dims - 1))
        length = np.sqrt((queries**2).sum(1)).astype(np.float32)
        return estimate, np.outer(length, (self.norm * (EPSILON * spread + 1e-4)).astype(np.float32))


def scores_of(vectors: np.ndarray, queries: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs, in double precision, some pairs at a time."""
    out = np.zeros(len(v))
    for at in range(0, len(v), 1 << 15):
        p = slice(at, at + (1 << 15))
        out[p] = (vectors[v[p]].astype(np.float64) * queries[q[p]]).sum(1)
    return out


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, nearest first, ties by id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def search(ids: np.ndarray, vectors: np.ndarray, codes: Codes, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """(query row, ids, scores) of the k nearest of a block that reach floor, each query's k-th best score known so far.

    floor rises while the block is gone through. A query's own id is no candidate."""
    none = np.zeros(0, np.int64)
    for at in range(0, len(query_ids), STEP):
        own, vecs, low = query_ids[at : at + STEP], queries[at : at + STEP], floor[at : at + STEP].copy()
        found = (none, none, np.zeros(0))
        begin = 0
        while begin < len(ids):
            end = min(len(ids), begin + (SLICE if np.isfinite(low).all() else STEP))  # few where all must be compared
            estimate, half = codes.part(slice(begin, end)).estimates(vecs)
            q, v = np.nonzero(estimate + half >= (low - 1e-6 * np.abs(low)).astype(np.float32)[:, None])
            other = ids[begin + v] != own[q]
            q, v = q[other], begin + v[other]
            score = scores_of(vectors, vecs, v, q)
            near = score >= low[q]
            found = best(*(np.concatenate(x) for x in zip(found, (q[near], ids[v[near]], score[near]), strict=True)), k)
            n = np.bincount(found[0], minlength=len(own))
            full = np.flatnonzero(n >= k)
            low[full] = np.maximum(low[full], found[2][np.cumsum(n)[full] - 1])
            begin = end
        yield at + found[0], found[1], found[2], at, low


def candidates(ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block without those that are among no query's k nearest for their many equals: of equal vectors the
    k + 1 smallest ids stay, and k rows of an id."""
    order = np.lexsort((ids, keys))
    key, own = keys[order], ids[order]
    same = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.zeros(0, bool)
    if not same.any():
        return np.arange(len(ids))
    same[1:] &= (vectors[order[1:]] == vectors[order[:-1]]).all(1)
    first = np.flatnonzero(~same)
    new_id = ~same | np.concatenate(([True], own[1:] != own[:-1]))
    nth_id = np.cumsum(new_id) - np.repeat(np.cumsum(new_id)[first], np.diff(np.append(first, len(own))))
    at = np.flatnonzero(new_id)
    nth_row = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
    return np.sort(order[(nth_id <= k) & (nth_row < k)])


# --- tables


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of the rows that take part: an id, one dimension at least, all finite, not all zero."""
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def index(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, vec (bytes), key (hash of vec), dims, lead (leading bits of the code), bits, norm, along of every vector."""

    def run(batches):
        for b in batches:
            sizes = np.diff(b.column("vec").offsets.to_numpy())
            flat = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(kind)
            start = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                v = flat[start[rows][:, None] + np.arange(dims)]
                codes = Codes.of(v.astype(np.float64))
                lead = np.zeros((len(rows), 2), np.uint8)
                lead[:, : codes.bits.shape[1]] = codes.bits[:, :2]
                lead = (lead[:, 0].astype(np.int32) << 8 | lead[:, 1]) >> (16 - CELL_BITS)
                cols = [b.column("vec_id").take(pa.array(rows)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(np.full(len(rows), dims, np.int32)), pa.array(lead.astype(np.int32)), pa.array([x.tobytes() for x in codes.bits], pa.binary()), pa.array(codes.norm), pa.array(codes.along)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "vec", "dims", "lead", "bits", "norm", "along"])

    coded = vectors.mapInArrow(run, "vec_id long, vec binary, dims int, lead int, bits binary, norm double, along double")
    return materialize(coded.withColumn("key", F.xxhash64("vec")), "ann-index")


def told(table: DataFrame, rows: int) -> DataFrame:
    """A table that all tasks may be told if it has no more than TOLD_ROWS rows; else the join is left to the planner."""
    return F.broadcast(table) if rows <= TOLD_ROWS else table


def in_blocks(coded: DataFrame) -> DataFrame:
    """coded with block: cells of as many leading bits as give blocks of the wished size, large cells cut by hash."""
    leads = materialize(coded.groupBy("dims", "lead").agg(F.count("*").alias("n")), "ann-leads")
    every = Window.partitionBy("dims")
    rows = F.least(F.greatest(F.shiftright("total", 6), F.lit(MIN_BLOCK)), F.lit(MAX_BLOCK))
    bits = F.least(F.lit(CELL_BITS), F.greatest(F.lit(0), F.floor(F.log2(F.col("total") / rows)))).cast("int")
    cells = leads.withColumn("total", F.sum("n").over(every)).withColumn("wished", rows).withColumn("cell", F.floor(F.col("lead") / F.pow(F.lit(2), F.lit(CELL_BITS) - bits)).cast("int"))
    cells = cells.withColumn("parts", F.ceil(F.sum("n").over(Window.partitionBy("dims", "cell")) / F.col("wished")).cast("int")).select("dims", "lead", "cell", "parts")
    part = F.pmod(F.xxhash64("vec_id", "part_"), F.col("parts"))  # rows that repeat an id are spread as well
    return coded.withColumn("part_", F.spark_partition_id()).join(told(cells, leads.count()), ["dims", "lead"]).withColumn("block", F.xxhash64("dims", "cell", part)).drop("cell", "parts", "part_", "lead")


def _blocks(batches):
    """Tables of the rows of each run of equal block, task; large runs of queries (kind 1) in parts."""
    rest, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
        task = b.column("task").to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]) | (task[1:] != task[:-1]))))
        for a, z in zip(edge, [*edge[1:], b.num_rows], strict=True):
            here = (block[a], task[a], kind[a])
            if rest and (here != at or (here[2] == 1 and sum(len(r) for r in rest) >= 4 * STEP)):
                yield at, pa.Table.from_batches(rest).combine_chunks()
                rest = []
            at = here
            rest.append(b.slice(a, z - a))
    if rest:
        yield at, pa.Table.from_batches(rest).combine_chunks()


def _block_of(t: pa.Table, kind: str, k: int) -> tuple[np.ndarray, np.ndarray, Codes]:
    dims = t.column("dims")[0].as_py()
    ids, vectors = t.column("id").to_numpy(), _matrix(t.column("vec"), dims, kind)
    rows = candidates(ids, t.column("key").to_numpy(), vectors, k)
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(t), -1)
    return ids[rows], vectors[rows], Codes(bits[rows], t.column("norm").to_numpy()[rows], t.column("along").to_numpy()[rows], dims)


def _as_vectors(placed: DataFrame) -> DataFrame:
    return placed.select("block", "task", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "key", "dims", "vec", "bits", "norm", "along", F.lit(None).cast("double").alias("floor"))


def described(placed: DataFrame, kind: str, k: int, every: int, partitions: int) -> DataFrame:
    """A row of each block (kind 0: centre, spread, radius), of each query in it (kind 1: id, vec, floor), and of what the
    query finds there (kind 2: id, key, other, score)."""

    def run(batches):
        for (block, _, _), t in _blocks(batches):
            own, vectors, codes = _block_of(t, kind, k)
            dims = vectors.shape[1]
            v = vectors.astype(np.float64)
            centre = v.mean(0)
            off = v - centre
            radius = float(np.sqrt((off**2).sum(1)).max())
            spread = float(np.sqrt(max(0.0, np.linalg.eigvalsh(off.T @ off / len(v))[-1])))
            ids = t.column("id").to_numpy()
            wanted = np.flatnonzero(ids % every == 0)
            asked = _matrix(t.column("vec").take(pa.array(wanted)), dims, kind)
            q_ids, q_keys = ids[wanted], t.column("key").to_numpy()[wanted]
            _, first = np.unique(np.stack([q_ids, q_keys], 1), axis=0, return_index=True)
            q_ids, q_keys, asked = q_ids[first], q_keys[first], asked[first]
            floor = np.full(len(first), -np.inf)
            near = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for row, found, score, at, reached in search(own, vectors, codes, q_ids, asked.astype(np.float64), floor.copy(), k):
                floor[at : at + len(reached)] = reached
                near.append((row, found, score))
            row, found, score = (np.concatenate(x) for x in zip(*near, strict=True))
            counts = (1, len(first), len(row))
            cols = [
                pa.array(np.full(sum(counts), block)), pa.array(np.repeat([0, 1, 2], counts).astype(np.int32)), pa.array(np.concatenate(([0], q_ids, q_ids[row]))),
                pa.array(np.concatenate(([0], q_keys, q_keys[row]))), pa.array(np.concatenate((np.zeros(counts[0] + counts[1], np.int64), found))), pa.array(np.full(sum(counts), dims, np.int32)),
                pa.array([centre.tobytes(), *(x.tobytes() for x in asked), *[None] * len(row)], pa.binary()), pa.array(np.concatenate(([spread], floor, score))), pa.array(np.append(radius, np.zeros(sum(counts) - 1))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["block", "kind", "id", "key", "other", "dims", "vec", "value", "radius"])

    rows = _as_vectors(placed.withColumn("task", F.lit(0))).repartition(partitions, "block").sortWithinPartitions("block", "task", "kind")
    return materialize(rows.mapInArrow(run, "block long, kind int, id long, key long, other long, dims int, vec binary, value double, radius double"), "ann-blocks")


def routed(blocks: DataFrame, kind: str, partitions: int) -> DataFrame:
    """block, id, key, dims, vec, floor: each distinct query at each block whose bound reaches its floor, but its own."""
    by_dims: dict[int, list] = {}
    for r in blocks.where("kind = 0").select("block", "dims", "vec", "value", "radius").toLocalIterator():
        by_dims.setdefault(r.dims, []).append((r.block, np.frombuffer(bytes(r.vec)), min(r.radius, BLOCK_EPSILON * r.value)))
    shared = blocks.sparkSession.sparkContext.broadcast({d: (np.array([x[0] for x in xs], np.int64), np.array([x[1] for x in xs]), np.array([x[2] for x in xs])) for d, xs in by_dims.items()})

    def run(batches):
        for b in batches:
            dims = b.column("dims").to_numpy()
            floor, homes = b.column("floor").to_numpy(), b.column("homes")
            home, home_row = homes.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(homes.offsets.to_numpy()))
            b = b.drop_columns(["homes"])
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                q = _matrix(b.column("vec").take(pa.array(rows)), d, kind).astype(np.float64)
                block, centre, reach = shared.value[d]
                length = np.sqrt((q**2).sum(1))
                for n in range(len(block)):
                    bound = q @ centre[n] + length * (reach[n] * (1 + 1e-9))
                    own = np.setdiff1d(rows[bound >= floor[rows] - 1e-9 * length], home_row[home == block[n]])
                    if len(own):
                        part = b.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block[n])), *part.columns], ["block", *part.schema.names])

    queries = blocks.where("kind = 1").repartition(partitions, "id", "key").groupBy("id", "key", "dims", "vec").agg(F.max("value").alias("floor"), F.collect_set("block").alias("homes"))
    return queries.mapInArrow(run, "block long, id long, key long, dims int, vec binary, floor double")


def searched(placed: DataFrame, asked: DataFrame, kind: str, k: int, partitions: int) -> DataFrame:
    """query_id, key, vec_id, score: of each query and block the k best that reach the query's floor."""
    hits = materialize(asked.groupBy("block").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("int").alias("tasks")), "ann-hits")
    few = told(hits, hits.count())
    null = lambda t: F.lit(None).cast(t)
    vectors = _as_vectors(placed.join(few, "block").select("*", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")))
    queries = asked.join(few, "block").select("block", F.pmod(F.xxhash64("id", "key"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), "id", "key", "dims", "vec", null("binary").alias("bits"), null("double").alias("norm"), null("double").alias("along"), "floor")

    def run(batches):
        for (_, _, of), t in _blocks(batches):
            if of == 0:
                ids, vectors, codes = _block_of(t, kind, k)
                continue
            own, key = t.column("id").to_numpy(), t.column("key").to_numpy()
            q = _matrix(t.column("vec"), codes.dims, kind).astype(np.float64)
            for row, found, score, *_ in search(ids, vectors, codes, own, q, t.column("floor").to_numpy().copy(), k):
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(key[row]), pa.array(found), pa.array(score)], ["query_id", "key", "vec_id", "score"])

    both = vectors.unionByName(queries).repartition(partitions, "block", "task").sortWithinPartitions("block", "task", "kind")
    return both.mapInArrow(run, "query_id long, key long, vec_id long, score double")


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by `every`, among all other rows.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id.
    Vectors meet those of their own length. Rows that repeat an id are each a candidate; those that differ in their
    vectors are each a query, equal ones are one query; a query's own id is no candidate. Ties go to the smaller id. With
    fewer than k candidates all are returned; an empty table gives none. Other columns are not read.
    The work is queries x vectors where no block can be left out, as in vectors without clusters; it is dealt to tasks
    of at most TASK_QUERIES queries and one block."""
    vectors = usable(df, id_col, vector_col)
    kind = "<f4" if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = in_blocks(index(vectors, kind))
    blocks = described(placed, kind, k, every, partitions)
    at_home = blocks.where("kind = 2").select(F.col("id").alias("query_id"), "key", F.col("other").alias("vec_id"), F.col("value").alias("score"))
    found = searched(placed, routed(blocks, kind, partitions), kind, k, partitions).unionByName(at_home)
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
