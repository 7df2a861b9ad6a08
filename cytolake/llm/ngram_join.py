"""N-gram Jaccard join with a count-vector R-tree, exact, in steps that each grow with the input.

1. Classes: texts with the same shingle set are one class; everything below is about classes. Sets are written once.
2. Blocking keys: a class's shingles are dealt into hashed cells, more than a linked pair can differ in, so that some
   non-empty cell must be equal in both. Prefix filtering over the cells' hashes, commonest cells last, leaves few keys.
3. Groups of classes that share a key become units. The classes of a large group first meet one of their number, its
   pivot, and some that it is not linked with; what is linked with them is connected already, and only blocks of classes
   that are not yet connected meet each other afterwards. So a group of near copies costs what it has members. Large
   groups with the same pivot are one, unless that makes more pairs.
4. Count-vector R-tree: a class's shingles are hashed into groups, the group counts are a point, and the sum of
   coordinate minima bounds a pair's overlap. Each unit's tree gives the pairs that are not connected yet and whose bound
   reaches the threshold; the classes that such pairs connect become a smaller unit.
5. Verification: in what units are left the sets themselves of surviving pairs are compared; links become edges of a
   forest, and connected components give every document its class.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, materialize, most_frequent, read_table, small_batches, tidy
from .textvec import U, mix64, shingle_sets

WIDTH = 5
#: Linked: 7 * overlap >= 3 * (sum of sizes), that is a Jaccard similarity of 0.75.
OVERLAP, SIZES = 3, 7
SMALL = 64  # below this size every shingle is a cell of its own
SEEDS, PLAIN = 4, -1  # seeds that are tried until all sets have enough cells; then every shingle is a cell, at any size
GROUPS = 64  # coordinates of a point, at least; a point has a quarter to half as many as its set has shingles
BLOCK = 512  # classes of a unit's side
UNIT_SHINGLES = 2_000_000  # of all sets of a unit that was put together from others
LEAF = 32
LEADERS, BARREN = 32, 8  # so many classes of a large group's part meet all others, of them so many that connect nothing
TASK_EDGES = 1 << 20  # so many edges are connected in one task (16 MB); more of them in rounds of all tasks
COMMON, MAX_COMMON = 8, 1 << 18  # a key of so many classes is common; so many are told to all tasks (2 MB), commonest first
TOLD_CLASSES = 1 << 22  # so many classes may be told to all tasks (32 MB)
BUCKET_BYTES = 24 << 20
KEY_BITS, MAX_BUCKETS = 42, 1 << 21  # of 64 bits, the rest number the buckets
MAX_SLICE, FLUSH_KEYS = 3 << 20, 400_000


# --- sets, cells and keys


def set_ids(every: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits that stand for each set: sets of n elements, none empty, one behind the other in `every`, in any order."""
    if not len(n):
        return np.zeros(0, np.int64)
    start = np.cumsum(n) - n
    total, both = np.add.reduceat(every, start), np.bitwise_xor.reduceat(mix64(every + U(0xA5A5)), start)
    return mix64(mix64(total) + both * U(0x9E3779B97F4A7C15) + n.astype(U)).astype(np.int64)


def set_id(s: np.ndarray) -> int:
    return int(set_ids(s, np.array([len(s)]))[0])


def level(n: int) -> int:
    return 0 if n < SMALL else n.bit_length() - 1


def cells(s: np.ndarray, lev: int, seed: int) -> np.ndarray:
    """Hashes of the non-empty cells of a sorted set at a level: each from all shingles in the cell."""
    if lev == 0 or seed == PLAIN:
        return s
    h = s if seed == 0 else np.sort(mix64(s + U(seed)))
    n = (3 << (lev + 1)) // 4 if lev < 8 else 1 << lev
    cell = ((h >> U(32)) * U(n)) >> U(32)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    return mix64(np.add.reduceat(mix64(h + U(77)), first) + cell[first] * U(0x9E3779B97F4A7C15) + U(lev))


def levels(n: int, seed: int = 0) -> list[tuple[int, int]]:
    """The levels at which a set of n shingles meets its partners, and how many shingles a pair can differ in there.

    A pair meets at the larger set's level, so a set also stands at the next one if a linked set can be that large."""
    if seed == PLAIN:
        return [(0, (n + 4 * n // 3) // 7)]
    lev = level(n)
    top = SMALL - 1 if lev == 0 else (2 << lev) - 1
    most = 4 * n // 3
    own = [(lev, (n + min(most, top)) // 7)]
    return own + [(level(top + 1), (n + most) // 7)] if most > top else own


def is_regular(s: np.ndarray, seed: int) -> bool:
    """Whether the set has more cells at its level than it can differ in from a set that is not larger."""
    return len(s) < SMALL or seed == PLAIN or len(cells(s, level(len(s)), seed)) > 2 * len(s) // 7


def keys(s: np.ndarray, seed: int, common: np.ndarray, rank: np.ndarray, buckets: int) -> np.ndarray:
    """A set's blocking keys: at each level as many cells as can differ and one more, rare cells first."""
    out = []
    for lev, differ in levels(len(s), seed):
        c = cells(s, lev, seed)
        if len(c) > differ + 1:
            if len(common):
                tag = short_key(c, buckets)
                at = np.minimum(np.searchsorted(common, tag), len(common) - 1)
                hit = common[at] == tag
                if hit.any():
                    often, at, c = c[hit], at[hit], c[~hit]
                    need = differ + 1 - len(c)
                    if need > 0:
                        c = np.concatenate((c, often[np.lexsort((often, rank[at]))][:need]))
            if len(c) > differ + 1:
                c = np.partition(c, differ)[: differ + 1]
        out.append(c)
    return np.concatenate(out)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets)) >> U(32)


def short_key(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a key that travel: KEY_BITS within its bucket."""
    return (bucket_of(key, buckets) << U(KEY_BITS)) | (mix64(key) >> U(64 - KEY_BITS))


# --- map and reduce sides of the exchange of keys, packed by bucket


def emit_keys(sets: DataFrame, seed: int, common: list[tuple[int, int]], buckets: int) -> DataFrame:
    """bucket, low, high (keys in two arrays), cls, counts: keys of all classes, many to a row."""
    table = sorted(common)
    shared = sets.sparkSession.sparkContext.broadcast((np.array([k for k, _ in table], U), np.array([n for _, n in table], np.int64)))

    def run(batches):
        tags, rank = shared.value
        found: list[np.ndarray] = []
        ids: list[int] = []
        held = 0

        def flush():
            if not found:
                return
            key = short_key(np.concatenate(found), buckets)
            cls = np.repeat(np.array(ids, np.int64), [len(k) for k in found])
            order = np.argsort(key >> U(KEY_BITS), kind="stable")
            key, cls = key[order], cls[order]
            bucket = (key >> U(KEY_BITS)).astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rows = []
            for a, b in zip(start, [*start[1:], len(key)], strict=True):
                own = cls[a:b]
                edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                count = np.diff(np.append(edge, b - a))
                rows.append((int(bucket[a]), (key[a:b] & U(0xFFFFFFFF)).astype("<u4").tobytes(), (key[a:b] >> U(32) & U((1 << KEY_BITS - 32) - 1)).astype("<u2").tobytes(), own[edge].astype("<i8").tobytes(), count.astype("<u4").tobytes()))
            names = ["bucket", "low", "high", "cls", "counts"]
            types = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for c, raw in zip(b.column("cls").to_pylist(), b.column("set").to_pylist(), strict=True):
                found.append(keys(np.frombuffer(raw, U), seed, tags, rank, buckets))
                ids.append(c)
                held += len(found[-1])
                if held > FLUSH_KEYS:
                    yield from flush()
                    found, ids, held = [], [], 0
        yield from flush()

    return sets.select("cls", "set").mapInArrow(tidy(run), "bucket int, low binary, high binary, cls binary, counts binary")


def by_bucket(packed: DataFrame, buckets: int, reduce, schema: str) -> DataFrame:
    """reduce(keys, classes, starts) of every bucket: its distinct (key, class) pairs by key, and where each key starts.
    Keys of one class alone are left out."""

    def one(rows):
        key = np.concatenate([np.frombuffer(r[0], "<u4").astype(U) | (np.frombuffer(r[1], "<u2").astype(U) << U(32)) for r in rows])
        cls = np.concatenate([np.repeat(np.frombuffer(r[2], "<i8"), np.frombuffer(r[3], "<u4")) for r in rows])
        order = np.argsort(key)
        key, cls = key[order], cls[order]
        same = key[1:] == key[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))  # most keys are one class's alone
        key, cls = key[several], cls[several]
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))) if len(key) else np.zeros(0, bool)
        key, cls = key[new], cls[new]
        return key, cls, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)

    def run(batches):
        at, rows = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for bucket, *rest in zip(*cols, strict=True):
                if bucket != at and rows:
                    yield from reduce(at, *one(rows))
                    rows = []
                at = bucket
                rows.append(rest)
        if rows:
            yield from reduce(at, *one(rows))

    return packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(tidy(run), schema)


def common_keys(packed: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """The commonest keys and their numbers of classes; decides the order of cells only, so that a bound loses nothing."""

    def reduce(bucket, key, cls, start):
        n = np.diff(np.append(start, len(key)))
        many = n >= COMMON
        tag = (U(bucket) << U(KEY_BITS)) | key[start[many]]
        yield pa.RecordBatch.from_arrays([pa.array(tag.astype(np.int64)), pa.array(n[many])], ["tag", "n"])

    rows = most_frequent(by_bucket(packed, buckets, reduce, "tag long, n long"), MAX_COMMON, "join-common").collect()
    return [(r.tag & 0xFFFFFFFFFFFFFFFF, r.n) for r in rows]


def groups(packed: DataFrame, buckets: int) -> DataFrame:
    """unit, cls, pivot, size: the groups of at least two classes; groups with the same classes are one."""

    def reduce(bucket, key, cls, start):
        end = np.append(start[1:], len(key))
        many = np.flatnonzero(end - start > 1)
        if not len(many):
            return
        sizes = end[many] - start[many]
        rows = np.repeat(start[many] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        member, begin = cls[rows], np.cumsum(sizes) - sizes
        unit = set_ids(member.astype(U), sizes)
        _, first = np.unique(unit, return_index=True)
        keep = np.repeat(np.isin(np.arange(len(unit)), first), sizes)
        order = mix64(member.astype(U))
        pivot = member[np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, begin), sizes))]  # one of each: hashes are one to one
        cols = [np.repeat(unit, sizes)[keep], member[keep], np.repeat(pivot, sizes)[keep], np.repeat(sizes, sizes)[keep]]
        for i in range(0, len(cols[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)].astype(np.int64)) for c in cols], ["unit", "cls", "pivot", "size"])

    return by_bucket(packed, buckets, reduce, "unit long, cls long, pivot long, size long").dropDuplicates(["unit", "cls"])


def sets_of(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, set of the wanted classes, once each. So many classes that tasks may be told them leave the others' sets where
    they are; more meet them by a shuffle."""
    few = materialize(wanted.select("cls").distinct(), "join-wanted")
    few = F.broadcast(few) if few.count() <= TOLD_CLASSES else few
    return sets.select("cls", "set").join(few, "cls", "left_semi").dropDuplicates(["cls"])


def led_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of linked sets: a forest. The first set meets all others, then some that are not connected with it do."""
    sizes = np.array([len(x) for x in sets])
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    label, asked = np.arange(len(sets)), np.zeros(len(sets), bool)
    left, right, lead, barren = [], [], 0, 0
    for _ in range(LEADERS):
        own = sets[lead]
        shared = np.bincount(owner[own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every], minlength=len(sets))
        linked = np.flatnonzero((SIZES * shared >= OVERLAP * (sizes + sizes[lead])) & (label != label[lead]))
        _, first = np.unique(label[linked], return_index=True)
        left.append(linked[first])
        right.append(np.full(len(first), lead))
        label[np.isin(label, label[linked])] = label[lead]
        asked[lead] = True
        barren += not len(first)
        apart = np.flatnonzero(~asked & (label != label[0]))
        if barren >= BARREN or not len(apart):
            break
        lead = int(apart[0])
    return np.concatenate(left), np.concatenate(right)


def with_pivots(large: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """a, b: linked classes of large groups, first those that are linked with the pivot. Many classes of a pivot are dealt
    to tasks by hash, in parts of about a block."""
    pairs = materialize(large.select("pivot", "cls").where("pivot <> cls").distinct(), "join-pivots")
    parts = materialize(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "join-pivot-parts")
    one = sets_of(sets, large)
    own = parts.join(one.withColumnRenamed("cls", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("pivot").alias("cls"), "set")
    others = pairs.join(parts, "pivot").join(one, "cls").select("pivot", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "cls", "set")

    def run(batches):
        for t in _unit_batches(batches):
            cls = t.column("cls").to_numpy()
            i, j = led_pairs([np.frombuffer(x, U) for x in t.column("set").to_pylist()])
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j])], ["a", "b"])

    both = own.unionByName(others).select(F.xxhash64("pivot", "part").alias("unit"), "kind", "cls", "set")
    return both.repartition(partitions, "unit").sortWithinPartitions("unit", "kind").mapInArrow(tidy(run), "a long, b long")


def merged_groups(large: DataFrame) -> DataFrame:
    """unit, cls, pivot: groups with the same pivot as one where that has no more pairs than they have together. A passage
    gives a group for each of its keys, with nearly the same classes."""
    once = large.groupBy("pivot", "cls").agg(F.sum("size").alias("n"))
    fewer = once.groupBy("pivot").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("k * k <= n").select("pivot", F.lit(True).alias("one"))
    unit = F.when(F.col("one"), F.col("pivot")).otherwise(F.col("unit"))
    return materialize(large.join(fewer, "pivot", "left").select(unit.alias("unit"), "cls", "pivot").distinct(), "join-merged")


def units(grouped: DataFrame, sets: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame | None]:
    """unit, cls, and node, root of the classes that pivots connect: small groups as they are; of large ones every two
    blocks of classes that are not connected. Classes that are connected are in blocks of their own, which do not meet each
    other."""
    small = grouped.where(F.col("size") <= BLOCK).select("unit", "cls")
    large = grouped.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return small, None
    large = merged_groups(large)
    roots = connections(with_pivots(large, sets, partitions))
    placed = large.select("unit", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sized = placed.groupBy("unit", "root").agg(F.count("*").alias("n"))
    sized = sized.withColumn("own", F.col("n") >= BLOCK // 4)  # large enough for blocks of its own
    rest = sized.where("not own").groupBy("unit").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts")).select("unit", F.lit(None).cast("long").alias("root"), "parts")
    table = materialize(sized.where("own").select("unit", "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")).unionByName(rest), "join-blocks")
    several = table.groupBy("unit").agg(F.count("*").alias("k"), F.max(F.col("root").isNull()).alias("mixed")).where("k > 1 or mixed").select("unit")
    table = table.join(several, "unit", "left_semi")
    placed = placed.join(several, "unit", "left_semi").join(sized.select("unit", "root", "own"), ["unit", "root"]).withColumn("root", F.when(F.col("own"), F.col("root"))).drop("own")
    mine = placed.alias("p").join(table.alias("t"), (F.col("p.unit") == F.col("t.unit")) & F.col("p.root").eqNullSafe(F.col("t.root"))).select("p.*", "t.parts")
    mine = mine.withColumn("block", F.struct("root", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))).drop("parts", "root")
    blocks = table.select(F.col("unit").alias("unit_"), F.col("root").alias("other_root"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    other = F.struct(F.col("other_root").alias("root"), F.col("other_part").alias("part"))
    meet = mine.join(blocks, (F.col("unit") == F.col("unit_")) & (F.col("block.root").isNull() | ~F.col("block.root").eqNullSafe(F.col("other_root"))))
    pair = meet.select(F.xxhash64("unit", F.least("block", other), F.greatest("block", other)).alias("unit"), "cls")
    return small.unionByName(pair), roots


# --- the R-tree


class Node:
    """A box of points: the largest value of each coordinate and the smallest size; the component, if all rows are of one;
    children, or rows of a leaf."""

    __slots__ = ("high", "size", "part", "children", "rows")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, rows: np.ndarray):
        self.high, self.size = points[rows].max(0), int(sizes[rows].min())
        self.rows, self.children = rows, None
        part, count = np.unique(parts[rows], return_counts=True)
        self.part = part[0] if len(part) == 1 else None
        if len(rows) > LEAF:
            if self.part is None and count.max() > LEAF:  # a component first, so that its rows need not meet
                inside = parts[rows] == part[count.argmax()]
                halves = rows[inside], rows[~inside]
            else:
                spread = points[rows].astype(np.int64)
                axis = int((spread.max(0) - spread.min(0)).argmax())
                order = rows[np.argsort(spread[:, axis], kind="stable")]
                halves = order[: len(order) // 2], order[len(order) // 2 :]
            self.children = tuple(Node(points, sizes, parts, x) for x in halves)


def surviving_pairs(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows whose summed coordinate minima reach the overlap of a linked pair; with parts, the component of
    each row, only pairs of different components."""
    left, right = [], []
    parts = np.arange(len(points)) if parts is None else parts
    root = Node(points, sizes, parts, np.arange(len(points)))
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if a.part is not None and a.part == b.part:
            continue
        if SIZES * int(np.minimum(a.high, b.high).sum(dtype=np.int64)) < OVERLAP * (a.size + b.size):
            continue
        if a.children is None and b.children is None:
            bound = np.minimum(points[a.rows][:, None], points[b.rows][None]).sum(-1, dtype=np.int64)
            i, j = np.nonzero((SIZES * bound >= OVERLAP * (sizes[a.rows][:, None] + sizes[b.rows][None])) & (parts[a.rows][:, None] != parts[b.rows][None]))
            if a is b:
                i, j = i[i < j], j[i < j]
            left.append(a.rows[i])
            right.append(b.rows[j])
        elif a is b:
            x, y = a.children
            stack += [(x, x), (x, y), (y, y)]
        elif b.children is None or (a.children is not None and len(a.rows) >= len(b.rows)):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, x) for x in b.children]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def groups_of(n: int) -> int:
    """How many groups the shingles of a set of n are hashed into: a power of two."""
    return max(GROUPS, 1 << (n // 4).bit_length())


def point(s: np.ndarray) -> bytes:
    """The group counts, in as few bytes as the largest needs."""
    g = groups_of(len(s))
    counts = np.bincount((s >> U(17)).astype(np.int64) & (g - 1), minlength=g)
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def points_of(packed: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points with as many groups as the smallest set has: groups that agree in the lower bits are added up."""
    least = groups_of(int(sizes.min()))
    out = np.zeros((len(packed), least), np.uint32)
    for i, (raw, n) in enumerate(zip(packed, sizes.tolist(), strict=True)):
        g = groups_of(n)
        out[i] = np.frombuffer(raw, "<u1" if len(raw) == g else "<u4").reshape(-1, least).sum(0)
    return out if out.max() >= 1 << 15 else out.astype(np.int16)


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component: in rounds, every component joins the smallest one that it touches."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = low != high
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def _unit_batches(batches):
    """The rows of each unit, as columns, from batches sorted by unit."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        u = t.column("unit").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        for a, z in zip(start[:-1], start[1:], strict=True):
            yield t.slice(a, z - a)
        rest = t.slice(start[-1])
    if rest is not None:
        yield rest


def _pairs_of(rows, batch: int = 1 << 16):
    """Record batches of (unit, cls) from an iterator of (unit, classes)."""
    unit, cls, held = [], [], 0
    for u, c in rows:
        unit.append(np.full(len(c), u, np.int64))
        cls.append(c)
        held += len(c)
        if held >= batch:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(unit)), pa.array(np.concatenate(cls))], ["unit", "cls"])
            unit, cls, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(unit)), pa.array(np.concatenate(cls))], ["unit", "cls"])


def rooted_rows(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of each cls by roots (node, root), which is cls itself if they do not have it."""
    if roots is None:
        return rows.withColumn("root", F.col("cls"))
    return rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def pruned_units(unit_table: DataFrame, classes: DataFrame, partitions: int, roots: DataFrame | None = None) -> DataFrame:
    """unit, cls: the parts of the units that pairs connect whose bound reaches the threshold, by pairs that roots do not
    connect."""

    def parts(batches):
        for t in _unit_batches(batches):
            cls, sizes = t.column("cls").to_numpy(), t.column("n").to_numpy()
            i, j = surviving_pairs(points_of(t.column("point").to_pylist(), sizes), sizes, t.column("root").to_numpy())
            label = connected(len(cls), i, j)
            order = np.argsort(label, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
            for a, b in zip(start, [*start[1:], len(order)], strict=True):
                if b - a > 1:
                    own = np.sort(cls[order[a:b]])
                    yield set_id(own.astype(U)), own

    with_points = unit_table.join(rooted_rows(classes.select("cls", "n", "point"), roots), "cls").select("unit", "cls", "n", "point", "root")
    sorted_units = with_points.repartition(partitions, "unit").sortWithinPartitions("unit")
    return sorted_units.mapInArrow(tidy(lambda batches: _pairs_of(parts(batches))), "unit long, cls long").distinct()


# --- verification


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the shingles that at least two sets have.

    Rare shingles are counted pair by pair, common ones by products of 0/1 matrices, some columns at a time."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    n = np.diff(np.append(start, len(every)))
    out = np.zeros(m * m, np.float32)
    wide = n > max(4, m // 10)
    for size in np.unique(n[~wide & (n > 1)]).tolist():
        at = start[n == size]
        step = max(1, (1 << 21) // (size * size))
        for a in range(0, len(at), step):
            who = owner[at[a : a + step, None] + np.arange(size)]
            pair, count = np.unique((who[:, :, None] * m + who[:, None, :]).ravel(), return_counts=True)
            out[pair] += count
    out = out.reshape(m, m)
    picks = np.flatnonzero(wide)
    for a in range(0, len(picks), 1024):
        columns = picks[a : a + 1024]
        flags = np.zeros((m, len(columns)), np.float32)
        for k, c in enumerate(columns):
            flags[owner[start[c] : start[c] + n[c]], k] = 1
        out += flags @ flags.T
    return out


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sets share; both are sorted."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def forest(sets: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest row of each row's component by the links among the pairs (i, j), and by label, the smallest rows of
    components that are known.

    In rounds, each row that is not connected with its next partner is compared with it; pairs whose rows are connected by
    then need no comparison."""
    label = np.arange(len(sets)) if label is None else label
    while len(i):
        _, first = np.unique(i, return_index=True)
        linked = np.array([SIZES * common_count(sets[x], sets[y]) >= OVERLAP * (sizes[x] + sizes[y]) for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True)], bool)
        if linked.any():
            joined = connected(len(sets), np.concatenate((np.arange(len(sets)), i[first[linked]])), np.concatenate((label, j[first[linked]])))
            label = joined
        rest = np.ones(len(i), bool)
        rest[first] = False
        rest &= label[i] != label[j]
        i, j = i[rest], j[rest]
    return label


def linked_edges(verify: DataFrame, sets: DataFrame, partitions: int, every: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """a, b: edges of a forest that connects the linked classes of each unit, besides those that roots connect; units may
    name an edge again. With every: all linked pairs of classes, a < b, once each.

    The sets of the classes travel to their units. The R-tree names the pairs to compare."""

    def edges(batches):
        for t in _unit_batches(batches):
            own = [np.frombuffer(x, U) for x in t.column("set").to_pylist()]
            cls, sizes = t.column("cls").to_numpy(), np.array([len(s) for s in own])
            if every:
                i, j = np.nonzero(np.triu(SIZES * overlaps(own) >= OVERLAP * (sizes[:, None] + sizes[None]), 1))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"])
                continue
            _, first, known = np.unique(t.column("root").to_numpy(), return_index=True, return_inverse=True)
            known = first[known]
            label = forest(own, sizes, *surviving_pairs(points_of([point(s) for s in own], sizes), sizes, known), known)
            moved = np.flatnonzero((known == np.arange(len(cls))) & (label != known))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(cls[moved]), pa.array(cls[label[moved]])], ["a", "b"])

    rows = verify.join(rooted_rows(sets_of(sets, verify), roots), "cls").repartition(partitions, "unit")
    found = rows.select("unit", "cls", "set", "root").sortWithinPartitions("unit").mapInArrow(tidy(edges), "a long, b long")
    return found.distinct() if every else found


def all_units(grouped: DataFrame, classes: DataFrame, partitions: int) -> DataFrame:
    """unit, cls: the pruned units of all groups, large ones in every two blocks."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = grouped.select("unit", "cls", parts.alias("parts")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    meet = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("parts = 1 or block <> other")
    return materialize(pruned_units(meet.select(F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "cls"), classes, partitions), "join-all-units")


def verification_units(pruned: DataFrame, classes: DataFrame) -> DataFrame:
    """unit, cls: the classes that units connect, each in one unit; where such a component is too large for a task, its
    classes stay in the units of before, which hold all of its pairs and are bounded."""
    first = pruned.groupBy("unit").agg(F.min("cls").alias("b"))
    roots = connections(pruned.join(first, "unit").select(F.col("cls").alias("a"), "b"))
    rooted = roots.select(F.col("node").alias("cls"), "root").unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())
    sized = rooted.join(classes.select("cls", "n"), "cls").groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    large = sized.where((F.col("k") > 2 * BLOCK) | (F.col("n") > UNIT_SHINGLES)).select("root")
    small = rooted.join(large, "root", "left_anti").select(F.col("root").alias("unit"), "cls")
    rest = rooted.join(large, "root", "left_semi").select("cls")
    return materialize(small.unionByName(pruned.join(rest, "cls", "left_semi").select("unit", "cls")), "join-verify")


def connections(edges: DataFrame) -> DataFrame:
    """components(), by one task if it can hold the edges: a round costs many small steps, however few the edges."""
    e = materialize(edges.where("a <> b"), "join-connections")
    if e.count() > TASK_EDGES:
        return components(e)

    def run(batches):
        pairs = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            node, row = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = connected(len(node), row[: len(a)], row[len(a) :])
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["node", "root"])

    return materialize(e.coalesce(1).mapInArrow(tidy(run), "node long, root long"), "join-roots")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of every node of edges (a, b): alternating large and small stars until no edge changes, which takes about
    the logarithm of the longest path; more than max_rounds are an error."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "join-edges")
    n = e.count()
    for _ in range(max_rounds if n else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, e = e, materialize(small.where("a <> b").distinct(), "join-stars")
        was, n = n, e.count()
        if n == was and e.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        if n:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def described(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text_hash, n, cls, point, regular of every row, and the set with the first rows of a class in a task."""

    def run(batches):
        done: set[int] = set()
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                sets = shingle_sets([(t or "").encode("utf-8", "replace") for t in part.column("text").to_pylist()], WIDTH)
                full = [s for s in sets if len(s)]
                ids = iter(set_ids(np.concatenate([np.zeros(0, U), *full]), np.array([len(s) for s in full], np.int64)).tolist())
                cls = [next(ids) if len(s) else None for s in sets]
                new = []
                for c in cls:
                    new.append(c is not None and c not in done)
                    if new[-1] and len(done) < 500_000:  # copies that slip by are told apart later
                        done.add(c)
                cols = [
                    part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()),
                    pa.array([point(s) if f else None for s, f in zip(sets, new, strict=True)], pa.binary()), pa.array([is_regular(s, seed) for s in sets], pa.bool_()),
                    pa.array([s.tobytes() if f else None for s, f in zip(sets, new, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n", "cls", "point", "regular", "set"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(run), "doc_id long, text_hash long, n long, cls long, point binary, regular boolean, set binary")


def joined_rows(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, text_hash, n, root, component_id for every row of docs (doc_id, text); no words: root is null.

    With links also n_links, the number of other rows that a row is linked with."""
    with small_batches(docs.sparkSession):  # every step below is written before the block ends
        return _joined_rows(docs, links)


def _joined_rows(docs: DataFrame, links: bool) -> DataFrame:
    spark = docs.sparkSession
    for seed in [*range(SEEDS), PLAIN]:  # sets with too few cells for the bound are so rare that another seed settles it
        table = materialize(described(docs, seed), "join-docs")
        if table.where(~F.col("regular")).isEmpty():
            break
    classes = materialize(table.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.first("point", True).alias("point")), "join-classes")
    sets = table.where(F.col("set").isNotNull()).select("cls", "set")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions, math.ceil(shingles * 5 / BUCKET_BYTES))
    buckets = min(buckets, MAX_BUCKETS)
    common = common_keys(emit_keys(sets, seed, [], buckets), buckets)
    grouped = materialize(groups(emit_keys(sets, seed, common, buckets), buckets), "join-units")
    candidates, by_pivot = units(grouped, sets, partitions)
    verify = verification_units(materialize(pruned_units(candidates, classes, partitions, by_pivot), "join-pruned"), classes)
    edges = linked_edges(verify, sets, partitions, roots=by_pivot)
    if by_pivot is not None:
        edges = edges.unionByName(by_pivot.toDF("a", "b"))
    roots = connections(edges)
    if links:  # all links, also those between classes that are connected already
        edges = materialize(linked_edges(all_units(grouped, classes, partitions), sets, partitions, True), "join-pairs")
    rooted = classes.select("cls", "class_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "class_id", F.coalesce("root", "cls").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("class_id").alias("component_id")), "root").select("cls", "root", "component_id")
    counted = []
    if links:
        size = table.where("n > 0").groupBy("cls").agg(F.count("*").alias("rows_"))
        both = edges.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("cls"), F.col("a").alias("other")))
        near = both.join(size.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("rows_").alias("near_"))
        degree = size.join(near, "cls", "left").select("cls", (F.col("rows_") - 1 + F.coalesce("near_", F.lit(0))).alias("links_"))
        named, counted = named.join(degree, "cls"), [F.coalesce("links_", F.lit(0)).alias("n_links")]
    return table.select("doc_id", "text_hash", "n", "cls").join(named, "cls", "left").select("doc_id", "text_hash", "n", "root", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *counted)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Texts without words (null, empty, white space) have no shingles and are their own component. Rows that repeat a
    text are in one component; rows that repeat an id are only if their texts link. A null id counts as larger than
    any other: a component of null ids only has a null component_id. Long texts are hashed in parts; a pair at exactly the
    threshold is linked. Empty tables give no rows, and columns besides the two named are not read."""
    rows = joined_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """jaccard_components() with n_links: the other rows that each row is linked with, those of the same set included.

    All linked pairs of classes are written, which is the square of a group of near copies with different sets."""
    rows = joined_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), True)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with one of each component: the smallest id, then the smallest text hash. Texts without words
    (null, empty, white space) are linked with nothing and stay, repeated or not; a null id is larger than any other. The
    columns are those of docs, which may have any names besides doc_id and text. An empty table stays empty."""
    first = joined_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where(F.col("root").isNotNull())
    first = first.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r")).select(F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("hash"))
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name of the table meets one of this function
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    worded = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = own.where(worded).withColumn("text_hash", F.xxhash64(text))
    kept = keyed.join(first, (F.col("text_hash") == F.col("hash")) & doc_id.cast("long").eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates([f"c{docs.columns.index('doc_id')}", "text_hash"]).select(*own.columns).unionByName(own.where(~worded)).toDF(*docs.columns)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS s FROM words),
sized AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets),
flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.other) AS component_id FROM sized s JOIN reach r USING (doc_id) GROUP BY s.doc_id
"""
