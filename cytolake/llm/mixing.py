"""Mixing sources to target weights by hash-threshold histograms (native DataFrame operations only).

Sizes are summed by source and by the leading bits of a document's hash; the bucket in which a source's budget runs
out is refined by the next bits, and the hash value found there is the source's threshold. Nothing is sorted by
document, and every document's decision is a comparison with its source's threshold. Documents that share the boundary
hash are told apart by a hash of their texts, and rows that are equal in that too are counted off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, word_count

#: Bits of the hash that each of the first levels resolves; the last level resolves the rest of HASH_BITS.
LEVEL_BITS, HASH_BITS = (12, 12), 60


def document_hash(*cols: Column) -> Column:
    """60 hash bits of a row's identity, the same in any engine that has md5."""
    key = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("?")) for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Per source (src, source_size) its target: all sizes shared by weight, no target above max_repeat x source_size.

    Sources are weighted in code point order, null last. Filling to the caps is solved in closed form: in order of
    cap / weight a source is capped as long as its cap is at most its share of what is left. Returns src, source_size,
    target, copies (whole repeats of every document) and budget (size still to take by threshold)."""
    rank = Window.orderBy(F.col("src").isNull(), F.col("src").cast("binary"))
    by_ratio = Window.orderBy("ratio", "pos")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    t = (
        sizes.withColumn("pos", F.row_number().over(rank) - 1)
        .withColumn("w", w)
        .withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("left_w") <= F.col("w") * F.col("left"))
        .withColumn("capped_size", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("capped_w", F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).over(whole))
    )
    share = F.col("w") * F.try_divide(F.col("total") - F.col("capped_size"), F.col("all_w") - F.col("capped_w"))
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(share))
    copies = F.when(F.col("source_size") == 0, 0).when(F.col("capped"), max_repeat).otherwise(
        F.least(F.lit(max_repeat), F.floor(F.try_divide(F.col("target"), F.col("source_size"))))
    )
    t = t.withColumn("copies", copies.cast("long"))
    budget = F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))
    return t.select("src", "source_size", "target", "copies", budget.alias("budget"))


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["src"].eqNullSafe(b["src"])


def _boundary(items: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """Per source of state (src, rest, at: equal columns so far) the value of a hash column at which rest runs out.

    Each level sums sizes by source and bucket, and keeps the bucket in which the cumulated sizes pass rest; a source
    whose documents all fit keeps none. Returns src, rest (what is left before that value), the value by the column's
    name, and rows, how many have it."""
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    done = 0
    for bits in [*LEVEL_BITS, HASH_BITS - sum(LEVEL_BITS)]:
        shift = HASH_BITS - done - bits
        same = _same_source(items, state) & (F.shiftrightunsigned(items[column], HASH_BITS - done) == state["prefix"])
        for c in set(state.columns) - {"src", "rest", "prefix"}:
            same &= items[c] == state[c]
        kept = [state[c] for c in state.columns if c not in ("src", "prefix")]
        hist = items.join(state, same).groupBy(items["src"].alias("src"), *kept, F.shiftrightunsigned(items[column], shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        past = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("src").orderBy("bucket"))).where(F.col("upto") > F.col("rest"))
        found = past.groupBy("src").agg(F.min_by(F.struct(*[c for c in past.columns if c != "src"]), "bucket").alias("b"))
        rest = (F.col("b.rest") - (F.col("b.upto") - F.col("b.n"))).alias("rest")
        last = [F.col("b.rows").alias("rows")] if not shift else []
        state = materialize(found.select("src", rest, *[f"b.{c}" for c in state.columns if c not in ("src", "rest", "prefix")], F.col("b.bucket").alias("prefix"), *last), "mix-level")
        done += bits
    return state.withColumnRenamed("prefix", column)


def thresholds(items: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with edge, edge2 and more: a document is taken once more if its hash u is below edge, or equal and its
    text's hash v is below edge2; of those that are equal in both, `more` rows are.

    items: src, size, u, v (HASH_BITS hash bits each). Sources whose documents all fit take the whole range."""
    at_u = _boundary(items, targets.where(F.col("budget") > 0).select("src", F.col("budget").alias("rest")), "u")
    if at_u.where("rows > 1").isEmpty():
        found = at_u.withColumn("v", F.lit(None).cast("long"))
    else:
        found = _boundary(items, at_u.select("src", "rest", "u"), "v")
    at = items.join(found.select(F.col("src").alias("src_"), F.col("u").alias("u_"), F.col("v").alias("v_"), "rest"), F.col("src").eqNullSafe(F.col("src_")) & (F.col("u") == F.col("u_")) & F.coalesce(F.col("v") == F.col("v_"), F.lit(True)))
    # equal rows have one size; so many of them come nearest to what is left
    edge = at.groupBy("src", "u", "v_").agg(F.ceil(F.first("rest") / F.max("size") - 0.5).alias("more"), F.count("*").alias("equal"))
    t, e = targets.alias("t"), edge.alias("e")
    whole = F.when(F.col("budget") <= 0, F.lit(0)).otherwise(F.coalesce(F.col("e.u"), F.lit(1 << HASH_BITS))).cast("long")
    any_text = F.col("e.u").isNotNull() & F.col("e.v_").isNull()  # no other row shares the boundary hash
    zero = lambda c: F.coalesce(c, F.lit(0))
    cut = t.join(e, F.col("t.src").eqNullSafe(F.col("e.src")), "left").select("t.*", whole.alias("edge"), F.coalesce("e.v_", F.lit(-1)).alias("edge2"), zero("e.more").alias("more"), zero("e.equal").alias("equal"), any_text.alias("any_text"))
    return materialize(cut, "mix-cut")


def repeats(rows: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (src, u, v and any others) with source_size, target and times, how often the mix takes each; items: src, size,
    u, v of the same rows."""
    cut = thresholds(items, targets)
    both = rows.join(cut, _same_source(rows, cut)).drop(cut["src"])
    # v decides only where several rows share the boundary hash
    tie = (F.col("u") == F.col("edge")) & (F.col("any_text") | (F.col("v") == F.col("edge2")))
    below = (F.col("u") < F.col("edge")) | ((F.col("u") == F.col("edge")) & (F.col("v") < F.col("edge2")))
    gone = ["copies", "budget", "edge", "edge2", "more", "equal", "any_text"]
    if cut.where("equal > 1").isEmpty():  # nothing to count off
        return both.withColumn("times", F.col("copies") + F.when(below | (tie & (F.col("more") > 0)), 1).otherwise(0)).drop(*gone)
    plain = both.where(~tie).withColumn("times", F.col("copies") + F.when(below, 1).otherwise(0))
    # rows at the boundary are numbered by the task that wrote them, each task from where those before it end
    at = materialize(both.where(tie).withColumn("nth", F.monotonically_increasing_id()), "mix-boundary")
    task = F.shiftright("nth", 33)
    counts = at.groupBy("src", task.alias("task")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("src").orderBy("task")
    counts = counts.select(F.col("src").alias("src_"), "task", (F.sum("n").over(order) - F.col("n")).alias("before"))
    numbered = at.withColumn("place", F.row_number().over(Window.partitionBy("src", task).orderBy("nth"))).join(counts, F.col("src").eqNullSafe(F.col("src_")) & (task == F.col("task")))
    numbered = numbered.withColumn("times", F.col("copies") + F.when(F.col("place") + F.col("before") <= F.col("more"), 1).otherwise(0))
    return plain.unionByName(numbered.select(plain.columns)).drop(*gone)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Null and empty texts, and those of white space, have size 0 and are taken 0 times; a null source is a source of its
    own, last in order. Rows that repeat an id are told apart by their texts, equal rows are counted off, so that hot
    ids and null ids do not miss the target. Long texts are counted without being split. Other columns are not read,
    whatever their names. Empty tables give no rows. Reruns agree: hashes depend on ids and texts only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), document_hash(F.col(id_col)).alias("u"), document_hash(text).alias("v")),
        "mix-sizes",
    )
    targets = materialize(source_targets(items.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_repeat), "mix-targets")
    return repeats(items, items, targets).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as it is taken, in the columns of docs, which may have any names besides
    doc_id, text and source.

    Texts without words (null, empty, white space) have no size, so the mix takes none of them. Ties, repeated rows, null
    ids and sources, and empty tables are as in mix()."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name of the table meets one of this function
    col = lambda name: F.col(f"c{docs.columns.index(name)}")
    text = F.coalesce(col("text"), F.lit(""))
    decided = own.select("*", col("source").alias("src"), document_hash(col("doc_id")).alias("u"), document_hash(text).alias("v"))
    items = materialize(decided.select("src", word_count(col("text")).alias("size"), "u", "v"), "mix-sizes")
    targets = materialize(source_targets(items.groupBy("src").agg(F.sum("size").alias("source_size"))), "mix-targets")
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    times = repeats(decided.where(worded), items, targets).where("times > 0")
    return times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*own.columns).toDF(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH items AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '?')), 1, 15))::BIGINT AS u, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS v
  FROM documents),
sums AS (SELECT src, sum(size)::BIGINT AS source_size FROM items GROUP BY src),
weighted AS (
  SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY src IS NULL, encode(src)) - 1) % 3 + 1]::DOUBLE AS w,
         row_number() OVER (ORDER BY src IS NULL, encode(src)) AS pos, 3.0::DOUBLE * source_size AS cap FROM sums),
run AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER r, 0) AS cap_before, coalesce(sum(w) OVER r, 0) AS w_before
  FROM weighted WINDOW r AS (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS capped FROM run),
targets AS (
  SELECT src, source_size, capped,
         CASE WHEN capped THEN cap ELSE w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
              / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ()) END AS target FROM flagged),
copied AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 3 ELSE least(3, floor(target / source_size)) END::BIGINT AS copies FROM targets),
budgets AS (SELECT *, greatest(0, target - copies * source_size) AS budget FROM copied),
cum AS (
  SELECT i.*, b.source_size, b.target, b.copies, b.budget, sum(size) OVER (PARTITION BY i.src ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS upto
  FROM items i JOIN budgets b ON i.src IS NOT DISTINCT FROM b.src)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN budget > 0 AND upto - size / 2::DOUBLE < budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM cum
"""
