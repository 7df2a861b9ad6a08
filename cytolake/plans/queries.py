"""The queries of the library's operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cli, workspace
from ..functions import stats
from ..operators import cluster, dmr, doublets, intervals, matrix, metacells, neighbors, plotdata, reduce, windows
from ..sources import genomes, readers
from ..streaming import ingest
from . import adapters
from .adapters import calls, cells, genes, rates, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that queries build on, in order of dependence.
CTES = adapters.SQL | {
    "win": """win AS (SELECT cell_id, chr, pos // 1000 * 1000 AS s, count(*) FILTER (c <> 0) AS m, count(*) FILTER (t <> 0) AS u, sum(c + t) AS n FROM calls GROUP BY ALL HAVING sum(c + t) >= 2)""",
    "mat": """mat AS (SELECT cell_id, chr || '_' || s || '_' || (s + 1000) AS feature, round(m / (m + u)::DOUBLE, 3) * 100 AS value FROM win)""",
    "agg": """agg AS (SELECT cell_id, chr, pos // 2000 * 2000 AS "start", pos // 2000 * 2000 + 2000 AS "end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t,
  count(*) FILTER (c <> 0) AS c_nz, count(*) FILTER (t <> 0) AS t_nz FROM calls GROUP BY ALL HAVING sum(c) <> 0 OR sum(t) <> 0)""",
    "bulk": """bulk AS (SELECT grp, chr, pos // 500 AS bin, sum(c) AS c, sum(t) AS t FROM calls JOIN cells USING (cell_id) GROUP BY ALL)""",
    "sm": """nb AS (SELECT chr, max(pos) // 500 + 1 AS bins FROM calls GROUP BY chr),
sm AS (SELECT grp, chr, (bin + o) * 500 AS "start", (bin + o + 1) * 500 AS "end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t
  FROM bulk CROSS JOIN (VALUES (-1), (0), (1)) v(o) JOIN nb USING (chr) WHERE bin + o >= 1 AND bin + o <= bins - 3 GROUP BY ALL HAVING sum(c) <> 0 OR sum(t) <> 0)""",
    "tests": """tot AS (SELECT *, sum(c) OVER w AS ac, sum(t) OVER w AS at_ FROM sm WINDOW w AS (PARTITION BY chr, "start", "end")),
tests AS (SELECT chr, "start", "end", grp || '_all' AS test, CASE WHEN ok THEN c END AS mc, CASE WHEN ok THEN t END AS mt, CASE WHEN ok THEN nc END AS nc, CASE WHEN ok THEN nt END AS nt
  FROM (SELECT *, (ac - c)::BIGINT AS nc, (at_ - t)::BIGINT AS nt, c + t > 3 AND ac - c + at_ - t > 3 AS ok FROM tot WHERE ac + at_ >= 3))""",
    "fc": """fc AS (SELECT *, CASE WHEN mc IS NULL OR (mc = 0 AND nc = 0) THEN NULL WHEN mc = 0 THEN '-infinity'::DOUBLE WHEN nc = 0 THEN 'infinity'::DOUBLE
  ELSE round(log2((mc / (mc + mt)::DOUBLE) / (nc / (nc + nt)::DOUBLE)), 4) END AS "logFC" FROM tests)""",
    "midp": """tabs AS (SELECT DISTINCT mc, mt, nc, nt FROM fc WHERE mc IS NOT NULL),
pmf AS (SELECT *, unnest(range(greatest(0, mc + mt - mt - nt), least(mc + mt, mc + nc) + 1)) AS x FROM tabs),
dens AS (SELECT mc, mt, nc, nt, x, exp(lgamma(mc + nc + 1) - lgamma(x + 1) - lgamma(mc + nc - x + 1) + lgamma(mt + nt + 1) - lgamma(mc + mt - x + 1) - lgamma(mt + nt - mc - mt + x + 1)
  - lgamma(mc + mt + nc + nt + 1) + lgamma(mc + mt + 1) + lgamma(nc + nt + 1)) AS p FROM pmf),
midp AS (SELECT mc, mt, nc, nt, least(1, 2 * least(coalesce(sum(p) FILTER (x < mc), 0) + sum(p) FILTER (x = mc) / 2, coalesce(sum(p) FILTER (x > mc), 0) + sum(p) FILTER (x = mc) / 2)) AS pval
  FROM dens GROUP BY ALL)""",
    "dmr": """dmr AS (SELECT fc.*, pval AS padj, CASE WHEN "logFC" < 0 THEN 'hypo' ELSE 'hyper' END AS direction FROM fc JOIN midp USING (mc, mt, nc, nt)
  WHERE pval < 0.2 AND abs("logFC") > 0.3)""",
    "pseudo": """pseudo AS (SELECT chr, "start", grp AS test, ((c * 37 + t * 11 + "start" // 500) % 997 + 1)::DOUBLE / 998 AS pval FROM sm)""",
}


def sql(body: str, *parts: str) -> str:
    names = [k for k in CTES if k in parts]
    return ("WITH " + ",\n".join(CTES[k] for k in names) + "\n" if names else "") + body


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def bed(spark, d):
    """Regions from all orders, spread over the range of the calls; most are short, so that gaps stay."""
    start = F.col("o_orderkey") * 10 + F.col("o_custkey") % 1000
    width = F.when(F.col("o_custkey") % 100 == 0, 1500).otherwise(20)
    return table(spark, d, "orders").select(F.concat(F.lit("chr"), (F.col("o_orderkey") % 7 + 1).cast("string")).alias("chr"), start.alias("start"), (start + width).alias("end")).distinct()


CTES["bed"] = """bed AS (SELECT DISTINCT 'chr' || (o_orderkey % 7 + 1) AS chr, o_orderkey * 10 + o_custkey % 1000 AS "start", o_orderkey * 10 + o_custkey % 1000 + CASE WHEN o_custkey % 100 = 0 THEN 1500 ELSE 20 END AS "end" FROM orders)"""


def mat(s, d):
    w = windows.make_windows(calls(s, d), stepsize=1000)
    return w.select("cell_id", F.concat_ws("_", "chr", "start", "end").alias("feature"), "value")


def agg(s, d):
    return windows.aggregate_windows(windows.step_windows(calls(s, d), 2000))


def sm(s, d):
    return windows.smoothed_windows(calls(s, d), cells(s, d))


def pseudo(s, d):
    return sm(s, d).select("chr", "start", F.col("grp").alias("test"), (((F.col("c") * 37 + F.col("t") * 11 + F.floor(F.col("start") / 500)) % 997 + 1).cast("double") / 998).alias("pval"))


def dmrs(s, d):
    return dmr.filter_dmr(dmr.test_dmr(sm(s, d)), "none", p_threshold=0.2, log_threshold=0.3)


def members(s, d):
    return cells(s, d).select(F.concat(F.lit("MC"), (F.col("cell_id") % 10).cast("string")).alias("metacell_id"), "cell_id")


CTES["members"] = "members AS (SELECT 'MC' || (cell_id % 10) AS metacell_id, cell_id FROM cells)"


def embedding(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))


def layout(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding")[0].cast("double").alias("dim_x"), F.col("embedding")[1].cast("double").alias("dim_y"))


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def r5(df, *cols):
    """Rounded after a shift that keeps means of four decimals away from ties."""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c) + 1e-9, 5))
    return df


def _written_windows(s, d):
    """Pre-aggregated windows of two names, written and read back by one of them."""
    path = f"{shared_folder(s)}/agg-{uuid.uuid4().hex}"
    for step in (2000, 5000):
        readers.write_aggregated(windows.aggregate_windows(windows.step_windows(calls(s, d), step)).withColumn("name", F.lit(f"w{step}")), path)
    return readers.read_aggregated(s, path, "w2000").drop("name")


# --- windows

for _metric, _value in (("percent", "r * 100"), ("score", "round(CASE WHEN r > g THEN (r - g) / nullif(1 - g, 0) ELSE (r - g) / nullif(g, 0) END, 3)"), ("ratio", "round(r / nullif(g, 0), 3)")):
    QUERIES[f"window_{_metric}"] = lambda s, d, m=_metric: windows.make_windows(calls(s, d), stepsize=1000, metric=m, rates=rates(calls(s, d)))
    SQL[f"window_{_metric}"] = sql(f'SELECT cell_id, chr, s AS "start", s + 1000 AS "end", {_value} AS value FROM (SELECT *, round(m / (m + u)::DOUBLE, 3) AS r FROM win) JOIN rates USING (cell_id)', "calls", "win", "rates")

query("bed_percent", sql('SELECT cell_id, chr, "start", "end", round(m / (m + u)::DOUBLE, 4) * 100 AS value FROM (SELECT cell_id, b.chr, b."start", b."end", count(*) FILTER (c <> 0) AS m, count(*) FILTER (t <> 0) AS u, sum(c + t) AS n FROM calls JOIN bed b ON calls.chr = b.chr AND pos BETWEEN b."start" AND b."end" GROUP BY ALL) WHERE n >= 2', "calls", "bed"))(
    lambda s, d: windows.make_windows(calls(s, d), bed=bed(s, d)))

_GENE = """first_ AS (SELECT * FROM genes QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY ord) = 1),
counted AS (SELECT cell_id, gene_name AS feature, count(*) FILTER (c <> 0) AS m, count(*) FILTER (t <> 0) AS u, sum(c + t) AS n
  FROM calls JOIN first_ f ON calls.chr = f.chr AND pos BETWEEN {lo} AND {hi} GROUP BY ALL)
SELECT cell_id, feature, round(m / (m + u)::DOUBLE, 4) * 100 AS value FROM counted WHERE n >= 2"""
_TSS = """(CASE WHEN strand = '+' THEN "start" ELSE "end" END)"""
query("gene_percent", sql("", "calls", "genes").rstrip() + ",\n" + _GENE.format(lo='"start"', hi='"end"'))(lambda s, d: windows.make_windows(calls(s, d), genes=genes(s, d)))
query("promoter_percent", sql("", "calls", "genes").rstrip() + ",\n" + _GENE.format(lo=f"{_TSS} - 1500", hi=f"{_TSS} + 1500"))(lambda s, d: windows.make_windows(calls(s, d), genes=genes(s, d), promoter=True))

query("group_window_mean", sql('SELECT grp, chr, s AS "start", s + 1000 AS "end", round(avg(round(m / (m + u)::DOUBLE, 3) * 100), 6) AS value FROM win JOIN cells USING (cell_id) GROUP BY ALL', "calls", "cells", "win"))(
    lambda s, d: r6(windows.make_windows(calls(s, d), stepsize=1000, groups=cells(s, d)), "value"))
query("load_windows", sql('SELECT cell_id, chr, "start", "end", round(c_nz / (c_nz + t_nz)::DOUBLE, 3) * 100 AS value FROM agg WHERE c_nz + t_nz >= 3', "calls", "agg"))(
    lambda s, d: windows.load_windows(agg(s, d), nmin=3))
query("smoothed_sum", sql("SELECT * FROM sm", "calls", "cells", "bulk", "sm"))(lambda s, d: sm(s, d).drop("pct"))
query("smoothed_pct", sql('SELECT grp, chr, "start", "end", round(100::DOUBLE * c / (c + t)::DOUBLE, 2) AS pct FROM sm', "calls", "cells", "bulk", "sm"))(lambda s, d: sm(s, d).drop("c", "t"))
query("smoothed_region_subset", sql("""SELECT * FROM sm WHERE chr = 'chr2' AND "start" <= 9000 AND "end" >= 3000""", "calls", "cells", "bulk", "sm"))(
    lambda s, d: windows.smoothed_windows(calls(s, d), cells(s, d), region=("chr2", 3000, 9000)).drop("pct"))
query("load_smoothed", sql("""SELECT grp, chr, "start" + 500 AS "start", "end" - 500 AS "end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t, round(100::DOUBLE * sum(c) / sum(c + t)::DOUBLE, 2) AS pct
FROM agg JOIN cells USING (cell_id) WHERE grp IN (SELECT grp FROM cells GROUP BY grp HAVING count(DISTINCT cell_id) > 1) GROUP BY grp, chr, "start", "end" HAVING sum(c_nz + t_nz) >= 10""", "calls", "cells", "agg"))(
    lambda s, d: windows.load_smoothed_windows(agg(s, d), cells(s, d)))
query("uniform_windows", sql('SELECT cell_id, chr, s AS "start", s + 1500 AS "end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t, count(*) FILTER (c <> 0) AS c_nz, count(*) FILTER (t <> 0) AS t_nz FROM (SELECT *, (floor((pos - 500) / 1500.0) * 1500 + 500)::BIGINT AS s FROM calls) GROUP BY ALL HAVING sum(c) <> 0 OR sum(t) <> 0', "calls"))(
    lambda s, d: windows.aggregate_windows(windows.step_windows(calls(s, d), 1500, 500)))
query("stepped_windows", sql('SELECT cell_id, chr, s AS "start", s + 1500 AS "end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t, count(*) FILTER (c <> 0) AS c_nz, count(*) FILTER (t <> 0) AS t_nz FROM (SELECT calls.*, pos // 500 * 500 - o * 500 AS s FROM calls CROSS JOIN (VALUES (0), (1), (2)) v(o)) GROUP BY ALL HAVING sum(c) <> 0 OR sum(t) <> 0', "calls"))(
    lambda s, d: cli.aggregate(calls(s, d), cli.parse_uniform("1500:500")).drop("name"))
query("custom_windows", sql('SELECT cell_id, b.chr, b."start", b."end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t, count(*) FILTER (c <> 0) AS c_nz, count(*) FILTER (t <> 0) AS t_nz FROM calls JOIN bed b ON calls.chr = b.chr AND pos >= b."start" AND pos < b."end" GROUP BY ALL HAVING sum(c) <> 0 OR sum(t) <> 0', "calls", "bed"))(
    lambda s, d: windows.aggregate_windows(windows.custom_windows(calls(s, d), bed(s, d))))
query("context_whitelist", sql("SELECT cell_id, count(*) AS n FROM calls WHERE cell_id IN (SELECT cell_id FROM cells WHERE batch = 0) GROUP BY cell_id", "calls", "cells"))(
    lambda s, d: windows.only(calls(s, d), cells(s, d).where("batch = 0"), "cell_id").groupBy("cell_id").agg(F.count("*").alias("n")))
query("context_blacklist", sql("SELECT cell_id, count(*) AS n FROM calls WHERE cell_id NOT IN (SELECT cell_id FROM cells WHERE batch = 0) GROUP BY cell_id", "calls", "cells"))(
    lambda s, d: windows.without(calls(s, d), cells(s, d).where("batch = 0"), "cell_id").groupBy("cell_id").agg(F.count("*").alias("n")))
query("metacell_windows", sql("""SELECT metacell_id, chr, s AS "start", s + 1000 AS "end", sum(m) / sum(m + u)::DOUBLE * 100 AS value FROM win JOIN members USING (cell_id) GROUP BY ALL""", "calls", "cells", "win", "members"))(
    lambda s, d: windows.metacell_windows(calls(s, d), members(s, d), 1000, "percent"))
query("metacell_smoothed")(lambda s, d: windows.metacell_smoothed_windows(calls(s, d), members(s, d)))
SQL["metacell_smoothed"] = "WITH " + ",\n".join(CTES[k] for k in ("calls", "cells", "members")) + ",\n" + """rows_ AS (SELECT chr, s, row_number() OVER (PARTITION BY chr ORDER BY s) AS r, count(*) OVER (PARTITION BY chr) AS n FROM (SELECT DISTINCT chr, pos // 1000 * 1000 AS s FROM calls JOIN members USING (cell_id))),
b AS (SELECT metacell_id, chr, pos // 1000 * 1000 AS s, sum(c) AS c, sum(t) AS t FROM calls JOIN members USING (cell_id) GROUP BY ALL)
SELECT b.metacell_id, y.chr, y.s AS "start", y.s + 1000 AS "end", sum(c)::BIGINT AS c, sum(t)::BIGINT AS t, round(100::DOUBLE * sum(c) / nullif(sum(c + t), 0)::DOUBLE, 2) AS pct
FROM b JOIN rows_ x ON b.chr = x.chr AND b.s = x.s JOIN rows_ y ON y.chr = x.chr AND abs(y.r - x.r) <= 1 WHERE y.r > 1 AND y.r < y.n GROUP BY ALL"""
query("genome_grid", """WITH c AS (SELECT 'chr' || l_linenumber AS chr, max(l_orderkey * 10) + 7 AS size FROM lineitem GROUP BY 1)
SELECT chr, g AS "start", least(g + 5000, size) AS "end" FROM c, LATERAL (SELECT unnest(range(0, size, 5000)) AS g)""")(
    lambda s, d: windows.genome_grid(table(s, d, "lineitem").groupBy(F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chr")).agg((F.max(F.col("l_orderkey") * 10) + 7).alias("size")), 5000))
query("fuzzy_gene_windows", "WITH " + ",\n".join(CTES[k] for k in ("calls", "genes")) + """,
w AS (SELECT cell_id, chr, pos // 500 * 500 AS s, round(count(*) FILTER (c <> 0) / (count(*) FILTER (c <> 0) + count(*) FILTER (t <> 0))::DOUBLE, 3) * 100 AS v FROM calls GROUP BY ALL HAVING sum(c + t) >= 2),
f AS (SELECT * FROM genes QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY ord) = 1)
SELECT cell_id, gene_name, round(avg(v), 6) AS value FROM w JOIN f ON w.chr = f.chr AND s >= "start" AND s + 500 <= "end" GROUP BY ALL""")(
    lambda s, d: r6(windows.fuzzy_gene_windows(calls(s, d), genes(s, d)), "value"))

query("sliding_window_means", sql("""SELECT grp, chr, "start", "end", round(avg(v), 6) AS value FROM (
  SELECT cell_id, chr, s AS "start", s + 1500 AS "end", round(count(*) FILTER (c <> 0) / (count(*) FILTER (c <> 0) + count(*) FILTER (t <> 0))::DOUBLE, 3) * 100 AS v
  FROM (SELECT calls.*, pos // 500 * 500 - o * 500 AS s FROM calls CROSS JOIN (VALUES (0), (1), (2)) v(o)) GROUP BY ALL HAVING sum(c + t) >= 2) JOIN cells USING (cell_id) GROUP BY ALL""", "calls", "cells"))(
    lambda s, d: r6(windows.make_windows(calls(s, d), stepsize=1500, slide=500, groups=cells(s, d)), "value"))
query("aggregated_scan", sql("SELECT * FROM agg", "calls", "agg"))(lambda s, d: _written_windows(s, d))
query("metacell_score", "WITH " + ",\n".join(CTES[k] for k in ("calls", "cells", "rates", "win", "members")) + """,
mr AS (SELECT metacell_id, avg(g) AS g FROM members JOIN rates USING (cell_id) GROUP BY 1),
p AS (SELECT metacell_id, chr, s, sum(m) / sum(m + u)::DOUBLE AS r FROM win JOIN members USING (cell_id) GROUP BY ALL)
SELECT metacell_id, chr, s AS "start", s + 1000 AS "end", round(CASE WHEN r > g THEN (r - g) / nullif(1 - g, 0) ELSE (r - g) / nullif(g, 0) END + 1e-9, 3) AS value FROM p JOIN mr USING (metacell_id)""")(
    lambda s, d: windows.metacell_windows(calls(s, d), members(s, d), 1000, "score", rates=rates(calls(s, d))))

# --- matrices

query("aggregate_matrix", sql("SELECT feature, grp, round(avg(value), 6) AS value FROM mat JOIN cells USING (cell_id) WHERE grp IN (SELECT grp FROM cells GROUP BY grp HAVING count(*) >= 5) GROUP BY ALL HAVING count(value) > 2", "calls", "cells", "win", "mat"))(
    lambda s, d: r6(matrix.aggregate_matrix(mat(s, d), cells(s, d), 5, 2), "value"))
query("matrix_means", sql("SELECT c.cell_id, c.grp, round(avg(value), 6) AS mean_pct FROM cells c LEFT JOIN mat USING (cell_id) GROUP BY ALL", "calls", "cells", "win", "mat"))(
    lambda s, d: r6(matrix.matrix_means(mat(s, d), cells(s, d).select("cell_id", "grp"), "mean_pct"), "mean_pct"))
query("coverage_filter", sql("SELECT * FROM mat WHERE feature IN (SELECT feature FROM mat GROUP BY feature HAVING count(value) >= 0.3 * (SELECT count(DISTINCT cell_id) FROM mat))", "calls", "win", "mat"))(
    lambda s, d: matrix.covered_features(mat(s, d), 0.3))
query("column_norm", sql("SELECT cell_id, feature, round(value / nullif(avg(value) OVER (PARTITION BY cell_id), 0), 6) AS value FROM mat", "calls", "win", "mat"))(
    lambda s, d: r6(matrix.column_normalised(mat(s, d)), "value"))
query("zscore", sql("SELECT cell_id, feature, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value FROM mat WINDOW w AS (PARTITION BY cell_id)", "calls", "win", "mat"))(
    lambda s, d: r6(matrix.z_scores(mat(s, d)), "value"))
query("high_sd_windows", sql("SELECT feature, round(stddev_samp(m), 6) AS sd FROM (SELECT feature, grp, avg(value) AS m FROM mat JOIN cells USING (cell_id) GROUP BY ALL HAVING count(value) > 1) GROUP BY feature HAVING count(*) > 2 ORDER BY stddev_samp(m) DESC, feature LIMIT 50", "calls", "cells", "win", "mat"))(
    lambda s, d: r6(matrix.variable_features(mat(s, d), cells(s, d), 50, 1, 2), "sd"))
query("matrix_wide", sql("PIVOT (SELECT feature, 'g_' || grp AS g, avg(value) AS v FROM mat JOIN cells USING (cell_id) GROUP BY ALL) ON g IN ('g_AFRICA', 'g_ASIA') USING round(first(v), 6) GROUP BY feature", "calls", "cells", "win", "mat"))(
    lambda s, d: r6(matrix.wide(mat(s, d).join(cells(s, d), "cell_id").groupBy("feature", "grp").agg(F.avg("value").alias("value")), ["g_AFRICA", "g_ASIA"], "g_"), "g_AFRICA", "g_ASIA"))
query("gene_context_percent", "WITH " + ",\n".join(CTES[k] for k in ("calls", "genes")) + """,
sites AS (SELECT DISTINCT chr, pos, ['CAC', 'CAG', 'CTG'][pos % 3 + 1] AS context FROM calls),
p AS (SELECT g.gene_name, context, sum(c) AS c, sum(t) AS t FROM calls JOIN sites USING (chr, pos) JOIN genes g ON g.chr = calls.chr AND pos BETWEEN g."start" AND g."end" GROUP BY ALL)
SELECT gene_name, context, round(100::DOUBLE * c / (c + t)::DOUBLE, 2) AS pct FROM p WHERE c + t >= 4""")(
    lambda s, d: matrix.context_percent(calls(s, d), calls(s, d).select("chr", "pos", F.element_at(F.array(F.lit("CAC"), F.lit("CAG"), F.lit("CTG")), (F.col("pos") % 3 + 1).cast("int")).alias("context")).distinct(), genes(s, d)))

# --- statistics and regions

_T = ("calls", "cells", "bulk", "sm", "tests")
query("dmr_counts", sql("SELECT * FROM tests", *_T))(lambda s, d: dmr.each_vs_all(sm(s, d)))
query("dmr_logfc", sql("SELECT * FROM fc", *_T, "fc"))(lambda s, d: dmr.with_log_fc(dmr.each_vs_all(sm(s, d))))
query("dmr_comparisons", sql("""SELECT chr, "start", "end", 'afr_am_vs_asia' AS test, CASE WHEN ok THEN mc END AS mc, CASE WHEN ok THEN mt END AS mt, CASE WHEN ok THEN nc END AS nc, CASE WHEN ok THEN nt END AS nt FROM (
SELECT *, mc + mt > 3 AND nc + nt > 3 AS ok FROM (SELECT chr, "start", "end", coalesce(sum(c) FILTER (grp IN ('AFRICA', 'AMERICA')), 0)::BIGINT AS mc, coalesce(sum(t) FILTER (grp IN ('AFRICA', 'AMERICA')), 0)::BIGINT AS mt,
coalesce(sum(c) FILTER (grp = 'ASIA'), 0)::BIGINT AS nc, coalesce(sum(t) FILTER (grp = 'ASIA'), 0)::BIGINT AS nt, count(*) FILTER (grp IN ('AFRICA', 'AMERICA', 'ASIA')) AS k FROM sm GROUP BY ALL HAVING sum(c + t) >= 3) WHERE k > 0)""", *_T[:4]))(
    lambda s, d: dmr.compared(sm(s, d), s.createDataFrame([("afr_am_vs_asia", "AFRICA,AMERICA", "ASIA,NOWHERE")], "name string, A string, B string")))
query("dmr_midp", sql("SELECT mc, mt, nc, nt, round(pval, 6) AS pval FROM midp", *_T, "fc", "midp"))(
    lambda s, d: dmr.test_dmr(sm(s, d)).where("mc is not null").select("mc", "mt", "nc", "nt", F.round("pval", 6).alias("pval")).distinct())

_RANKS = "r AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, rank() OVER (PARTITION BY {by} ORDER BY pval) AS lo, rank() OVER (PARTITION BY {by} ORDER BY pval) + count(*) OVER (PARTITION BY {by}, pval) - 1 AS hi FROM pseudo)"
_ADJ = {
    "bonferroni": "least(1, pval * n)",
    "bh": "least(1, min(pval * n / hi) OVER (PARTITION BY {by} ORDER BY pval DESC))",
    "holm": "least(1, max((n - lo + 1) * pval) OVER (PARTITION BY {by} ORDER BY pval))",
    "hochberg": "least(1, min((n - hi + 1) * pval) OVER (PARTITION BY {by} ORDER BY pval DESC))",
    "fdr": "least(1, min(pval * n / hi) OVER (PARTITION BY {by} ORDER BY pval DESC))",
    "by": "least(1, min(pval * n / hi) OVER (PARTITION BY {by} ORDER BY pval DESC) * list_sum([1 / i::DOUBLE for i in range(1, n + 1)]))",
}
for _m, _e in _ADJ.items():
    _by = "1"
    QUERIES[f"padj_{_m}"] = lambda s, d, m=_m: r6(stats.adjust(pseudo(s, d), method={"bh": "BH", "by": "BY"}.get(m, m)), "padj")
    SQL[f"padj_{_m}"] = sql("", "calls", "cells", "bulk", "sm", "pseudo").rstrip() + ",\n" + _RANKS.format(by=_by) + f'\nSELECT chr, "start", test, pval, round({_e.format(by=_by)}, 6) AS padj FROM r'
query("padj_within_test", sql("", "calls", "cells", "bulk", "sm", "pseudo").rstrip() + ",\n" + _RANKS.format(by="test") + f'\nSELECT chr, "start", test, pval, round({_ADJ["bh"].format(by="test")}, 6) AS padj FROM r')(
    lambda s, d: r6(stats.adjust(pseudo(s, d), method="BH", by=["test"]), "padj"))
query("padj_hommel", sql("", "calls", "cells", "bulk", "sm", "pseudo").rstrip() + """,
r AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY pval) AS i, count(*) OVER (PARTITION BY test) AS n FROM pseudo),
l AS (SELECT test, n, list(pval ORDER BY i) AS p FROM r GROUP BY test, n),
ms AS (SELECT test, n, p, unnest(range(2, n)) AS m FROM l),
q AS (SELECT test, n, m, p[n - m + 1] AS edge, list_min([m * p[n - m + j] / j::DOUBLE for j in range(2, m + 1)]) AS q1 FROM ms),
s AS (SELECT test, min(n * pval / i::DOUBLE) AS simes FROM r GROUP BY test),
b AS (SELECT r.test, r.i, max(least(m * least(r.pval, edge), q1)) AS v FROM r JOIN q ON q.test = r.test GROUP BY r.test, r.i)
SELECT chr, "start", test, pval, round(least(1, greatest(pval, simes, coalesce(v, 0))), 6) AS padj FROM r JOIN s USING (test) LEFT JOIN b USING (test, i)""")(lambda s, d: r6(stats.adjust(pseudo(s, d), method="hommel", by=["test"]), "padj"))

_D = (*_T, "fc", "midp", "dmr")
query("dmr_filter", sql('SELECT chr, "start", "end", test, mc, mt, nc, nt, "logFC", round(padj, 6) AS padj, direction FROM dmr', *_D))(lambda s, d: r6(dmrs(s, d), "padj").drop("pval"))
_PADJ = """nt AS (SELECT count(*) AS n, count(DISTINCT (chr, "start", "end")) AS w FROM fc JOIN midp USING (mc, mt, nc, nt)),
adj AS (SELECT chr, "start", "end", test, mc, mt, nc, nt, "logFC", pval, least(1, pval * nt.{n}) AS padj, CASE WHEN "logFC" < 0 THEN 'hypo' ELSE 'hyper' END AS direction FROM fc JOIN midp USING (mc, mt, nc, nt), nt)
SELECT chr, "start", "end", test, mc, mt, nc, nt, "logFC", round(pval, 6) AS pval, round(padj, 6) AS padj, direction FROM adj"""
query("dmr_keep_all", sql("", *_T, "fc", "midp").rstrip() + ",\n" + _PADJ.format(n="n"))(lambda s, d: r6(dmr.filter_dmr(dmr.test_dmr(sm(s, d)), keep_all=True), "pval", "padj"))
query("dmr_within_group", sql("", *_T, "fc", "midp").rstrip() + ",\n" + _PADJ.format(n="w") + """ WHERE padj < 0.9 AND abs("logFC") > 0.3""")(
    lambda s, d: r6(dmr.filter_dmr(dmr.test_dmr(sm(s, d)), level="withinGroup", p_threshold=0.9, log_threshold=0.3), "pval", "padj"))
_ISLES = """pad AS (SELECT *, "start" - 500 AS s, "end" + 500 AS e FROM dmr),
m AS (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM pad),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
col AS (SELECT {k}, min(s) + 500 AS dmr_start, max(e) - 500 AS dmr_end, max(e) - min(s) - 1000 AS dmr_length, round(avg(padj) + 1e-9, 5) AS dmr_padj, round(avg({v}) + 1e-9, 5) AS "dmr_logFC" FROM i GROUP BY {k}, g HAVING max(e) - min(s) - 1000 >= 500)"""
query("dmr_collapse", sql("", *_D).rstrip() + ",\n" + _ISLES.format(k="test, chr, direction", v='"logFC"') + "\nSELECT * FROM col")(
    lambda s, d: r5(dmr.collapse_dmr(dmrs(s, d), 500, 500), "dmr_padj", "dmr_logFC"))
query("dmr_collapse_merged", sql("", *_D).rstrip() + ",\n" + _ISLES.format(k="test, chr", v='abs("logFC")') + "\nSELECT * FROM col")(
    lambda s, d: r5(dmr.collapse_dmr(dmrs(s, d), 500, 500, True), "dmr_padj", "dmr_logFC"))
query("dmr_annotate", sql("", "genes", *_D).rstrip() + ",\n" + _ISLES.format(k="test, chr, direction", v='"logFC"') + """,
f AS (SELECT * FROM genes QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY ord) = 1)
SELECT col.*, (SELECT string_agg(gene_name, ', ' ORDER BY "start", gene_name) FROM f WHERE f.chr = col.chr AND f."start" <= dmr_end AND f."end" >= dmr_start) AS gene_names FROM col""")(
    lambda s, d: r5(dmr.annotate(dmr.collapse_dmr(dmrs(s, d), 500, 500), genes(s, d)), "dmr_padj", "dmr_logFC"))
query("dmr_gene_list", SQL["dmr_annotate"].replace("SELECT col.*, (SELECT", "SELECT DISTINCT test, unnest(string_split(gene_names, ', ')) AS gene_name FROM (SELECT col.*, (SELECT") + ")")(lambda s, d: dmr.gene_list(dmr.annotate(dmr.collapse_dmr(dmrs(s, d), 500, 500), genes(s, d))))

_RS = """v AS (SELECT feature, grp, value FROM mat JOIN cells USING (cell_id)),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY feature, value) AS tie, count(*) OVER (PARTITION BY feature) AS n FROM v),
tt AS (SELECT *, sum(tie * tie - 1) OVER (PARTITION BY feature) AS tied FROM rk),
g AS (SELECT feature, grp, count(*) AS n1, any_value(n) AS n, sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS w, any_value(tied) AS tied, avg(value) AS mean1 FROM tt GROUP BY ALL)"""
query("cluster_markers_ranksum", sql("", "calls", "cells", "win", "mat").rstrip() + ",\n" + _RS + """
SELECT feature, grp, n1, (n - n1)::BIGINT AS n2, w, round((w - n1 * (n - n1) / 2.0::DOUBLE - sign(w - n1 * (n - n1) / 2.0::DOUBLE) * 0.5::DOUBLE) / nullif(sqrt(n1 * (n - n1) / 12.0::DOUBLE * (n + 1 - tied / nullif(n * (n - 1), 0)::DOUBLE)), 0), 6) AS z FROM g""")(
    lambda s, d: r6(stats.rank_sums(mat(s, d).join(cells(s, d).select("cell_id", "grp"), "cell_id")), "z").select("feature", "grp", "n1", "n2", "w", "z"))
query("cluster_markers_means", sql("""SELECT feature, grp, count(*) AS n1, round(avg(value), 6) AS mean1, round((any_value(total) - sum(value)) / nullif(any_value(n) - count(*), 0), 6) AS mean2
FROM (SELECT feature, grp, value, sum(value) OVER (PARTITION BY feature) AS total, count(*) OVER (PARTITION BY feature) AS n FROM mat JOIN cells USING (cell_id)) GROUP BY ALL""", "calls", "cells", "win", "mat"))(
    lambda s, d: r6(stats.rank_sums(mat(s, d).join(cells(s, d).select("cell_id", "grp"), "cell_id")), "mean1", "mean2").select("feature", "grp", "n1", "mean1", "mean2"))
query("cluster_markers")(lambda s, d: dmr.cluster_markers(mat(s, d), cells(s, d), 3, min_values=True))

_REF = """a AS (SELECT feature, grp, avg(value) AS x FROM mat JOIN cells USING (cell_id) GROUP BY ALL),
b AS (SELECT feature, 'batch' || batch AS ref, avg(value) AS y FROM mat JOIN cells USING (cell_id) GROUP BY ALL),
cr AS (SELECT ref, grp, round(corr(x, y), 6) AS r FROM a JOIN b USING (feature) GROUP BY ALL)"""


def _correlated(s, d, method="pearson", digits=None):
    """digits: means are rounded, so that ties are ties however they were added up."""
    m = mat(s, d).join(cells(s, d), "cell_id")
    mean = F.avg("value") if digits is None else F.round(F.avg("value"), digits)
    a = m.groupBy("feature", "grp").agg(mean.alias("value"))
    b = m.groupBy("feature", F.concat(F.lit("batch"), F.col("batch").cast("string")).alias("ref")).agg(mean.alias("value"))
    return matrix.reference_correlation(a, b, method)


query("reference_correlation", sql("", "calls", "cells", "win", "mat").rstrip() + ",\n" + _REF + "\nSELECT * FROM cr")(lambda s, d: r6(_correlated(s, d), "r"))
query("top_correlations", sql("", "calls", "cells", "win", "mat").rstrip() + ",\n" + _REF + "\nSELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r DESC, ref)::INTEGER AS rank FROM cr) WHERE rank <= 1")(
    lambda s, d: matrix.top_correlations(r6(_correlated(s, d), "r"), 1))
query("spearman_correlation", sql("", "calls", "cells", "win", "mat").rstrip() + ",\n" + _REF.rsplit(",\ncr AS", 1)[0].replace("avg(value)", "round(avg(value), 6)") + """,
j AS (SELECT ref, grp, x, y FROM a JOIN b USING (feature)),
k AS (SELECT ref, grp, rank() OVER (PARTITION BY ref, grp ORDER BY x) + (count(*) OVER (PARTITION BY ref, grp, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY ref, grp ORDER BY y) + (count(*) OVER (PARTITION BY ref, grp, y) - 1) / 2.0::DOUBLE AS y FROM j)
SELECT ref, grp, round(corr(x, y), 6) AS r FROM k GROUP BY ALL""")(lambda s, d: r6(_correlated(s, d, "spearman", 6), "r"))
query("kendall_correlation")(lambda s, d: _correlated(s, d, "kendall"))
query("dual_rank_top", sql("", *_D).rstrip() + """,
q AS (SELECT chr, "start", "end", test, direction, round(padj, 6) AS padj, "logFC" FROM dmr),
k AS (SELECT *, row_number() OVER (PARTITION BY test, direction ORDER BY padj, chr, "start", "end")::INTEGER AS rank_p, row_number() OVER (PARTITION BY test, direction ORDER BY abs("logFC") DESC, chr, "start", "end")::INTEGER AS rank_fc FROM q)
SELECT *, rank_p + rank_fc AS total_rank FROM k QUALIFY rank() OVER (PARTITION BY test, direction ORDER BY rank_p + rank_fc) <= 5""")(
    lambda s, d: dmr.dual_rank_top(r6(dmrs(s, d), "padj").select("chr", "start", "end", "test", "direction", "padj", "logFC"), 5))
query("overlap_class_share", "WITH " + ",\n".join(CTES[k] for k in ("genes", "bed")) + """,
h AS (SELECT DISTINCT g.chr, g."start", g."end", strand, EXISTS (SELECT 1 FROM bed b WHERE b.chr = g.chr AND b."start" <= g."end" AND b."end" >= g."start") AS has_overlap FROM genes g)
SELECT strand, has_overlap AS "overlaps", count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY strand)::DOUBLE, 6) AS share FROM h GROUP BY strand, has_overlap""")(
    lambda s, d: r6(dmr.overlap_shares(genes(s, d), bed(s, d), "strand"), "share"))
query("region_venn", "WITH " + ",\n".join(CTES[k] for k in ("genes", "bed")) + """,
a AS (SELECT chr, "start", "end", 'genes' AS name FROM genes UNION ALL SELECT chr, "start", "end", 'bed' FROM bed),
m AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR "start" > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT chr, min("start") AS "start", max("end") AS "end", string_agg(DISTINCT name, ',' ORDER BY name) AS members FROM i GROUP BY chr, g""")(
    lambda s, d: dmr.region_venn(genes(s, d).select("chr", "start", "end", F.lit("genes").alias("name")).unionByName(bed(s, d).withColumn("name", F.lit("bed")))))
query("covered_sites", sql('SELECT DISTINCT calls.chr, pos FROM calls JOIN bed b ON calls.chr = b.chr AND pos BETWEEN b."start" AND b."end"', "calls", "bed"))(
    lambda s, d: dmr.covered_sites(bed(s, d), calls(s, d).select("chr", "pos")))
query("balanced_downsample", sql("", "calls", "cells", "win", "mat").rstrip() + """,
b AS (SELECT cell_id, grp, ((row_number() OVER (PARTITION BY grp ORDER BY cell_id) - 1) % 5)::INTEGER AS bin FROM cells)
SELECT grp, bin, feature, round(avg(value), 6) AS value FROM mat JOIN b USING (cell_id) GROUP BY ALL""")(lambda s, d: r6(dmr.balanced_means(mat(s, d), cells(s, d), 5), "value"))
query("group_regression", """WITH f AS (SELECT l_returnflag AS grp, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1)
SELECT grp, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2 FROM f""")(
    lambda s, d: r6(dmr.group_regression(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), "grp", "l_quantity", "l_extendedprice"), "slope", "r2").withColumn("intercept", F.round("intercept", 4)).drop("p_value"))
# the tail of Student's t as an integral over an angle, by Simpson's rule
query("regression_p_values", """WITH f AS (SELECT c_nationkey AS grp, count(*) AS n, regr_slope(c_acctbal, c_custkey) AS slope, corr(c_custkey, c_acctbal) AS r FROM customer GROUP BY 1),
t AS (SELECT *, atan(abs(r) / sqrt(1 - r * r)) AS a, n - 2 AS v FROM f),
g AS (SELECT *, (pi() / 2 - a) / 4000 AS h, exp(lgamma((v + 1) / 2.0::DOUBLE) - lgamma(v / 2.0::DOUBLE)) / sqrt(pi()) AS k FROM t),
i AS (SELECT grp, n, slope, h, k, unnest(range(0, 4001)) AS j, a, v FROM g)
SELECT grp, n, round(slope, 6) AS slope, round(2 * any_value(k) * sum(CASE WHEN j IN (0, 4000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(a + j * h), 0), v - 1)) * any_value(h) / 3, 6) AS p_value FROM i GROUP BY grp, n, slope""")(
    lambda s, d: r6(dmr.group_regression(table(s, d, "customer").withColumnRenamed("c_nationkey", "grp"), "grp", "c_custkey", "c_acctbal"), "slope", "p_value").select("grp", "n", "slope", "p_value"))

# --- genes, ranges, containers


def _populated(s, d):
    """A track that has one gene's windows (with other values), filled up for two genes and their surroundings."""
    tracks = sm(s, d).select("chr", "start", "end", "grp", "pct")
    own = workspace.populate_track(None, tracks, genes(s, d), ["Brand#1_ECONOMY"], overhang=0).withColumn("pct", -F.col("pct"))
    return workspace.populate_track(own, tracks, genes(s, d), ["Brand#1_ECONOMY", "Brand#2_ECONOMY"])


def _annotated(s, d):
    """Two annotation columns written as a file without a header, read and joined."""
    path = f"{shared_folder(s)}/annot-{uuid.uuid4().hex}"
    parity = F.when(F.col("cell_id") % 2 == 0, "even").otherwise("odd")
    cells(s, d).select("cell_id", F.concat(F.lit("L"), (F.col("cell_id") % 3).cast("string")), parity).write.csv(path, sep="\t")
    own = cells(s, d).select(F.col("cell_id").cast("string").alias("cell_id"), "grp")
    return workspace.add_metadata(own, readers.read_annotation(s, path, "kind", "parity")).withColumn("cell_id", F.col("cell_id").cast("bigint"))



query("chr_index", sql("SELECT cell_id, chr, min(i) AS \"start\", count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY chr, pos, c, t) AS i FROM calls) WHERE NOT regexp_matches(chr, '_|EBV|M') GROUP BY ALL", "calls"))(
    lambda s, d: intervals.chromosome_index(calls(s, d)))
query("gene_index", sql("SELECT cell_id, gene_name, min(i) AS first, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY chr, pos, c, t) AS i FROM calls) x JOIN genes g ON g.chr = x.chr AND pos BETWEEN g.\"start\" AND g.\"end\" GROUP BY ALL", "calls", "genes"))(
    lambda s, d: intervals.gene_index(calls(s, d), genes(s, d)))
query("gene_calls", sql("""SELECT DISTINCT cell_id, calls.chr, pos, c, t FROM calls JOIN genes g ON g.chr = calls.chr AND pos BETWEEN g."start" AND g."end" WHERE gene_name = (SELECT min(gene_name) FROM genes)""", "calls", "genes"))(
    lambda s, d: intervals.gene_calls(calls(s, d), genes(s, d), genes(s, d).agg(F.min("gene_name")).first()[0]))
query("gene_coords", sql("""SELECT chr || '_' || "start" || '_' || "end" AS location FROM genes WHERE gene_name = 'Brand#1_ECONOMY'""", "genes"))(lambda s, d: intervals.gene_coords(genes(s, d), "Brand#1_ECONOMY"))
query("gene_ranges", sql("""SELECT chr, greatest(0, "start" - 5000) AS "start", "end" + 5000 AS "end", gene_name FROM genes QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY "end" - "start" DESC, ord) = 1""", "genes"))(
    lambda s, d: intervals.gene_ranges(genes(s, d)))
query("coding_promoters", sql("""SELECT chr, tss - 1500 AS "start", tss + 1500 AS "end", gene_name, ord, strand FROM (SELECT *, CASE WHEN strand = '+' THEN "start" ELSE "end" END AS tss FROM genes QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY "end" - "start" DESC, ord) = 1)""", "genes"))(
    lambda s, d: intervals.coding_ranges(genes(s, d), True))
query("parse_regions", sql("""SELECT DISTINCT split_part(feature, '_', 1) AS chr, split_part(feature, '_', 2)::BIGINT AS "start", split_part(feature, '_', 3)::BIGINT AS "end" FROM mat""", "calls", "win", "mat"))(
    lambda s, d: intervals.parse_regions(mat(s, d).select("feature").distinct(), "feature"))
query("windows_in_ranges", sql("""SELECT DISTINCT m.chr, m."start", m."end" FROM (SELECT DISTINCT chr, s AS "start", s + 1000 AS "end" FROM win) m JOIN bed b ON b.chr = m.chr AND m."start" >= b."start" AND m."end" <= b."end\"""", "calls", "win", "bed"))(
    lambda s, d: intervals.windows_within(windows.make_windows(calls(s, d), stepsize=1000).select("chr", "start", "end").distinct(), bed(s, d)))
query("region_merge", "WITH " + CTES["bed"] + """,
m AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM bed),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR "start" > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT chr, min("start") AS "start", max("end") AS "end" FROM i GROUP BY chr, g""")(lambda s, d: intervals.merged(bed(s, d), ["chr"]))
query("add_metadata", sql("SELECT c.cell_id, c.grp, c.batch, c.cov, n.n FROM cells c LEFT JOIN (SELECT cell_id, count(*) AS n FROM calls GROUP BY 1) n USING (cell_id)", "calls", "cells"))(
    lambda s, d: workspace.add_metadata(cells(s, d), calls(s, d).groupBy("cell_id").agg(F.count("*").alias("n"))))
query("add_prefix", sql("SELECT 'a_' || cell_id AS cell_id, feature, value FROM mat", "calls", "win", "mat"))(lambda s, d: workspace.Workspace(cells=cells(s, d), matrices={"m": mat(s, d)}).add_prefix("a_").matrices["m"])
query("subset_cells", sql("SELECT * FROM mat WHERE cell_id IN (SELECT cell_id FROM cells WHERE grp = 'ASIA')", "calls", "cells", "win", "mat"))(
    lambda s, d: workspace.Workspace(cells=cells(s, d), matrices={"m": mat(s, d)}).subset(cells(s, d).where("grp = 'ASIA'")).matrices["m"])
query("combine_union", sql("SELECT '1_' || cell_id AS cell_id, feature, value FROM mat UNION ALL SELECT '2_' || cell_id, feature, value FROM mat", "calls", "win", "mat"))(
    lambda s, d: workspace.combine([workspace.Workspace(cells=cells(s, d), matrices={"m": mat(s, d)}).add_prefix(p) for p in ("1_", "2_")]).matrices["m"])
query("track_upsert")(
    lambda s, d: workspace.upsert_track(sm(s, d).select("chr", "start", "end", "grp", "pct").where("start % 1000 = 0"), sm(s, d).select("chr", "start", "end", "grp", (F.col("pct") * 0 - 1).alias("pct"))))
SQL["track_upsert"] = sql("""SELECT chr, "start", "end", grp, CASE WHEN "start" % 1000 = 0 THEN round(100::DOUBLE * c / (c + t)::DOUBLE, 2) ELSE -1 END AS pct FROM sm""", "calls", "cells", "bulk", "sm")
query("populate_track", sql("", "calls", "cells", "genes", "bulk", "sm").rstrip() + """,
rg AS (SELECT * FROM genes WHERE gene_name IN ('Brand#1_ECONOMY', 'Brand#2_ECONOMY') QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY "end" - "start" DESC, ord) = 1),
tr AS (SELECT chr, "start", "end", grp, round(100::DOUBLE * c / (c + t)::DOUBLE, 2) AS pct, EXISTS (SELECT 1 FROM rg b WHERE gene_name = 'Brand#1_ECONOMY' AND b.chr = sm.chr AND sm."start" >= greatest(0, b."start") AND sm."end" <= b."end") AS old,
  EXISTS (SELECT 1 FROM rg b WHERE b.chr = sm.chr AND sm."start" >= greatest(0, b."start" - 5000) AND sm."end" <= b."end" + 5000) AS new FROM sm)
SELECT chr, "start", "end", grp, CASE WHEN old THEN -pct ELSE pct END AS pct FROM tr WHERE old OR new""")(
    lambda s, d: _populated(s, d))
query("add_annotation", sql("SELECT c.cell_id, c.grp, 'L' || c.cell_id % 3 AS kind, CASE WHEN c.cell_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM cells c", "cells"))(lambda s, d: _annotated(s, d))
query("job_membership", sql("SELECT metacell_id, string_agg('b' || cell_id, ',' ORDER BY 'b' || cell_id) AS barcodes FROM members GROUP BY 1", "cells", "members"))(
    lambda s, d: members(s, d).groupBy("metacell_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("b"), F.col("cell_id").cast("string")))), ",").alias("barcodes")))
query("job_json")(lambda s, d: metacells.job_spec(members(s, d), cells(s, d).select("cell_id", F.concat(F.lit("b"), F.col("cell_id").cast("string")).alias("barcode"), F.lit("/x.h5").alias("path")), windows.genome_grid(genomes.chromosome_sizes(s, "mm39"), 10_000_000)))
query("marker_genes", "SELECT unnest([" + ", ".join(f"'{g.upper()}'" for g in readers.PBMC_MARKERS) + "]) AS gene_name")(lambda s, d: readers.fetch_markers(s, "human"))

# --- neighbours, labels, reductions

_LAB = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 <> 0 THEN 'L' || label END AS label FROM embeddings),
kn AS (SELECT q.vec_id AS cell_id, b.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), b.vec_id) AS r
  FROM v q JOIN v b ON q.label IS NULL AND b.label IS NOT NULL),
vt AS (SELECT cell_id, label, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, label) AS r FROM kn WHERE r <= 5 GROUP BY cell_id, label)"""
query("knn_label_transfer", "WITH " + _LAB + "\nSELECT cell_id, label FROM vt WHERE r = 1 UNION ALL SELECT vec_id, label FROM v WHERE label IS NOT NULL")(
    lambda s, d: neighbors.transfer_labels(embedding(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("label"))))
query("knn_topk", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id AS cell_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), b.vec_id)::INTEGER AS rank
FROM v q JOIN v b ON q.vec_id % 10 = 0) WHERE rank <= 5""")(
    lambda s, d: neighbors.knn(embedding(s, d).where("cell_id % 10 = 0"), embedding(s, d), 5).select("query_id", "cell_id", "rank"))
query("cluster_label_transfer", """WITH n AS (SELECT c_custkey % 40 AS cluster, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2),
b AS (SELECT cluster, label FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cluster) - 1 AS k FROM b)
SELECT cluster, CASE WHEN k = 0 THEN label ELSE label || '.' || k END AS label FROM a""")(
    lambda s, d: neighbors.transfer_cluster_labels(table(s, d, "customer").select((F.col("c_custkey") % 40).alias("cluster_id"), F.col("c_mktsegment").alias("type"))))
query("coverage_residuals", """WITH x AS (SELECT vec_id, ln((vec_id % 50 + 10)::DOUBLE) AS lc, unnest(embedding)::DOUBLE AS y, unnest(range(len(embedding))) AS d FROM embeddings),
f AS (SELECT d, regr_slope(y, lc) AS b, regr_intercept(y, lc) AS a FROM x GROUP BY d)
SELECT vec_id AS cell_id, d::INTEGER AS dim, round(y - a - b * lc, 6) AS residual FROM x JOIN f USING (d)""")(
    lambda s, d: r6(reduce.regress_out(embedding(s, d), embedding(s, d).select("cell_id", (F.col("cell_id") % 50 + 10).alias("cov"))).select("cell_id", F.posexplode("vec").alias("dim", "residual")), "residual"))
query("metacell_mean_reduction", """WITH x AS (SELECT 'MC' || vec_id % 20 AS metacell_id, unnest(embedding)::DOUBLE AS y, unnest(range(len(embedding))) AS d FROM embeddings)
SELECT metacell_id, d::INTEGER AS dim, round(avg(y), 6) AS value FROM x GROUP BY ALL""")(
    lambda s, d: r6(metacells.mean_reduction(embedding(s, d).select(F.concat(F.lit("MC"), (F.col("cell_id") % 20).cast("string")).alias("metacell_id"), "cell_id"), embedding(s, d)).select("metacell_id", F.posexplode("vec").alias("dim", "value")), "value"))
query("metacell_metadata", sql("SELECT metacell_id, round(avg(cov), 4) AS cov, count(*) AS n_cells, string_agg(cell_id::VARCHAR, ',' ORDER BY cell_id) AS \"originating_cellIDs\" FROM members JOIN cells USING (cell_id) GROUP BY 1", "cells", "members"))(
    lambda s, d: metacells.metacell_metadata(members(s, d), cells(s, d).select("cell_id", "cov")).withColumn("cov", F.round("cov", 4)))
query("svd_singular_values")(lambda s, d: s.createDataFrame([(i, float(v)) for i, v in enumerate(reduce.singular_values(mat(s, d), cells(s, d), 10))], "dim int, sigma double"))
query("dim_estimate")(lambda s, d: s.createDataFrame([(reduce.estimate_dims(mat(s, d), cells(s, d), 11, 0.9),)], "dims int"))
query("svd_embedding")(lambda s, d: reduce.truncated_svd({"m": mat(s, d)}, cells(s, d), {"m": 5}))
query("louvain")(lambda s, d: cluster.cluster_cells(embedding(s, d), 15))
query("leiden")(lambda s, d: cluster.cluster_cells(embedding(s, d), 15, "leiden", 0.05))
query("umap")(lambda s, d: reduce.umap(embedding(s, d)))
query("tsne")(lambda s, d: reduce.tsne(embedding(s, d)))
query("impute")(lambda s, d: reduce.impute(mat(s, d), cells(s, d)))
query("metacells")(lambda s, d: metacells.make_metacells(embedding(s, d), 25))
query("metacells_dbscan")(lambda s, d: metacells.make_metacells(embedding(s, d), 25, mode="dbscan"))
query("metacells_adaptive")(lambda s, d: metacells.make_metacells(embedding(s, d), 25, mode="adaptive"))


@query("doublet_scores")
def _doublets(s, d):
    m, flags = doublets.simulated(mat(s, d), cells(s, d), 0.5)
    e = reduce.truncated_svd({"m": m}, flags, {"m": 5})
    model, _ = doublets.fit_model(e, flags)
    return doublets.scores(model, e)


# --- plots

query("sample_composition", sql("SELECT grp, batch, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp)::DOUBLE, 6) AS share FROM cells GROUP BY grp, batch", "cells"))(
    lambda s, d: r6(plotdata.composition(cells(s, d), "grp", "batch"), "share"))
_LAY = "lay AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS dim_x, embedding[2]::DOUBLE AS dim_y FROM embeddings)"
query("dim_labels", "WITH " + CTES["cells"] + f",\n{_LAY}\nSELECT grp, round(avg(dim_x), 6) AS x, round(avg(dim_y), 6) AS y FROM cells JOIN lay USING (cell_id) GROUP BY grp")(
    lambda s, d: r6(plotdata.dim_labels(cells(s, d), layout(s, d), "grp"), "x", "y"))
query("dim_points", "WITH " + CTES["cells"] + f",\n{_LAY}\nSELECT * FROM cells JOIN lay USING (cell_id)")(lambda s, d: plotdata.dim_points(cells(s, d), layout(s, d)))
query("dim_values", sql("", "calls", "cells", "win", "mat").rstrip() + f",\n{_LAY}\nSELECT cell_id, feature, value, grp, batch, cov, dim_x, dim_y FROM mat JOIN cells USING (cell_id) JOIN lay USING (cell_id) WHERE feature IN ('chr1_0_1000', 'chr2_1000_2000')")(
    lambda s, d: plotdata.dim_values(mat(s, d), ["chr1_0_1000", "chr2_1000_2000"], cells(s, d), layout(s, d)))
query("dim_blend", sql("", "calls", "win", "mat").rstrip() + f""",
{_LAY},
v AS (SELECT cell_id, max(value) FILTER (feature = 'chr1_0_1000') AS r, max(value) FILTER (feature = 'chr2_1000_2000') AS g, (SELECT max(value) FROM mat WHERE feature IN ('chr1_0_1000', 'chr2_1000_2000')) AS top FROM mat GROUP BY cell_id)
SELECT cell_id, dim_x, dim_y, '#' || printf('%02X', round(r / top * 255)::INTEGER) || printf('%02X', round(g / top * 255)::INTEGER) || '00' AS mix FROM v JOIN lay USING (cell_id) WHERE r IS NOT NULL AND g IS NOT NULL""")(lambda s, d: plotdata.blended(mat(s, d), ["chr1_0_1000", "chr2_1000_2000"], layout(s, d)))
query("violin_values", sql("SELECT feature, cell_id, grp, value FROM mat JOIN cells USING (cell_id) WHERE feature IN ('chr1_0_1000', 'chr3_2000_3000')", "calls", "cells", "win", "mat"))(
    lambda s, d: plotdata.violin_values(mat(s, d), ["chr1_0_1000", "chr3_2000_3000"], cells(s, d), "grp"))
query("dot_means", sql("SELECT grp, feature, round(avg(value), 6) AS mean_size, round(avg(value / 100), 6) AS mean_colour FROM mat JOIN cells USING (cell_id) WHERE feature IN ('chr1_0_1000', 'chr3_2000_3000') GROUP BY ALL", "calls", "cells", "win", "mat"))(
    lambda s, d: r6(plotdata.dot_means(mat(s, d), mat(s, d).withColumn("value", F.col("value") / 100), ["chr1_0_1000", "chr3_2000_3000"], cells(s, d), "grp"), "mean_size", "mean_colour"))
query("heat_track")(
    lambda s, d: r6(plotdata.track_values(sm(s, d).select("grp", "chr", "start", "end", "pct"), bed(s, d), 1000, True), "glob_m"))
SQL["heat_track"] = sql("", "calls", "cells", "bulk", "sm", "bed").rstrip() + """,
tr AS (SELECT grp, chr, "start", "end", round(100::DOUBLE * c / (c + t)::DOUBLE, 2) AS pct FROM sm),
gm AS (SELECT grp, round(avg(pct), 6) AS glob_m FROM tr GROUP BY grp)
SELECT tr.*, ("start" + "end") / 2::DOUBLE AS middle, glob_m FROM tr JOIN gm USING (grp)
WHERE EXISTS (SELECT 1 FROM bed b WHERE b.chr = tr.chr AND tr."start" >= greatest(0, b."start" - 1000) AND tr."end" <= b."end" + 1000)"""
query("track_subset", sql("", "calls", "cells", "genes", "bulk", "sm").rstrip() + """,
rg AS (SELECT * FROM genes WHERE gene_name = 'Brand#1_ECONOMY' QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY "end" - "start" DESC, ord) = 1)
SELECT grp, chr, "start", "end", round(100::DOUBLE * c / (c + t)::DOUBLE, 2) AS pct, ("start" + "end") / 2::DOUBLE AS middle FROM sm
WHERE regexp_matches(grp, '^A.*A$') AND EXISTS (SELECT 1 FROM rg b WHERE b.chr = sm.chr AND sm."start" >= greatest(0, b."start" - 5000) AND sm."end" <= b."end" + 5000)""")(
    lambda s, d: plotdata.gene_track(sm(s, d).select("grp", "chr", "start", "end", "pct"), genes(s, d), ["Brand#1_ECONOMY"], baseline=False, subset="^A.*A$"))
query("gene_track", sql("", "calls", "cells", "genes", "bulk", "sm").rstrip() + """,
tr AS (SELECT grp, chr, "start", "end", round(100::DOUBLE * c / (c + t)::DOUBLE, 2) AS pct FROM sm),
gm AS (SELECT grp, round(avg(pct), 6) AS glob_m FROM tr GROUP BY grp),
rg AS (SELECT * FROM genes WHERE gene_name IN ('Brand#1_ECONOMY', 'Brand#2_ECONOMY') QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY "end" - "start" DESC, ord) = 1)
SELECT tr.*, ("start" + "end") / 2::DOUBLE AS middle, glob_m FROM tr JOIN gm USING (grp)
WHERE EXISTS (SELECT 1 FROM rg b WHERE b.chr = tr.chr AND tr."start" >= greatest(0, b."start" - 5000) AND tr."end" <= b."end" + 5000)""")(
    lambda s, d: r6(plotdata.gene_track(sm(s, d).select("grp", "chr", "start", "end", "pct"), genes(s, d), ["Brand#1_ECONOMY", "Brand#2_ECONOMY"]), "glob_m"))
query("genome_chr_order", "SELECT DISTINCT 'chr' || l_suppkey % 23 AS chr, dense_rank() OVER (ORDER BY l_suppkey % 23)::INTEGER AS chr_rank FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 23).cast("string")).alias("chr")).distinct().withColumn("chr_rank", F.row_number().over(Window.orderBy(*plotdata.chromosome_order(F.col("chr"))))))
query("genome_heat", sql("", "calls", "cells", "win", "mat").rstrip() + """,
a AS (SELECT feature, grp, round(avg(value), 6) AS value FROM mat JOIN cells USING (cell_id) WHERE grp IN (SELECT grp FROM cells GROUP BY grp HAVING count(*) >= 5) GROUP BY ALL HAVING count(value) > 2)
SELECT split_part(feature, '_', 1) AS chr, split_part(feature, '_', 2)::BIGINT AS "start", split_part(feature, '_', 3)::BIGINT AS "end", grp, value, dense_rank() OVER (ORDER BY substr(split_part(feature, '_', 1), 4)::INTEGER)::INTEGER AS chr_rank FROM a""")(
    lambda s, d: r6(plotdata.genome_heat(matrix.aggregate_matrix(mat(s, d), cells(s, d), 5, 2)), "value"))
query("color_max_q999", sql("SELECT 0::DOUBLE AS low, CASE WHEN avg(pct) > 10 THEN 100 ELSE quantile_cont(pct, 0.999) END::DOUBLE AS high FROM (SELECT round(round(100::DOUBLE * c / (c + t)::DOUBLE, 2) / 10, 4) AS pct FROM sm)", "calls", "cells", "bulk", "sm"))(
    lambda s, d: plotdata.colour_range(sm(s, d).select(F.round(F.col("pct") / 10, 4).alias("pct"))))
query("metacell_points", "WITH " + CTES["cells"] + ",\n" + CTES["members"] + f""",
{_LAY}, ml AS (SELECT metacell_id, round(avg(dim_x), 6) AS meta_x, round(avg(dim_y), 6) AS meta_y FROM members JOIN lay USING (cell_id) GROUP BY 1)
SELECT cell_id, metacell_id, dim_x, dim_y, meta_x, meta_y FROM members JOIN lay USING (cell_id) JOIN ml USING (metacell_id)""")(
    lambda s, d: plotdata.metacell_points(members(s, d), layout(s, d), r6(members(s, d).join(layout(s, d), "cell_id").groupBy(F.col("metacell_id").alias("cell_id")).agg(F.avg("dim_x").alias("dim_x"), F.avg("dim_y").alias("dim_y")), "dim_x", "dim_y")))
query("meta_map")(lambda s, d: plotdata.meta_map(windows.metacell_smoothed_windows(calls(s, d), members(s, d)).select("chr", "start", "end", F.col("metacell_id").alias("grp"), "pct"), bed(s, d)))
query("palettes")(lambda s, d: plotdata.palette_table(s))

# --- sequences, streaming kernels

_FASTA = [(0, ">chrA test"), (1, "ACGTCCGA"), (2, "CGNNCATG"), (3, ">chrB"), (4, "TTCAGG"), (5, "C"), (6, "G")]
_SEQ = "seqs AS (SELECT * FROM (VALUES ('chrA', 'ACGTCCGACGNNCATG'), ('chrB', 'TTCAGGCG')) v(chr, q)), ix AS (SELECT chr, q, unnest(range(1, len(q) + 1)) AS e FROM seqs)"
query("cg_sites", f"WITH {_SEQ} SELECT chr, e - 1 + o AS pos, 'CG' AS motif, CASE WHEN o = 0 THEN '+' ELSE '-' END AS strand FROM ix CROSS JOIN (VALUES (0), (1)) v(o) WHERE e >= 2 AND substr(q, e - 1, 2) = 'CG'")(
    lambda s, d: readers.scan_motifs(s.createDataFrame(_FASTA, "ord bigint, value string"), "CG"))
query("chn_sites", f"""WITH {_SEQ}, g AS (SELECT chr, e, substr('NN' || q, e, 3) AS k FROM ix)
SELECT chr, e - 2 AS pos, k AS motif, '+' AS strand FROM g WHERE regexp_matches(k, '^C[^G]')
UNION ALL SELECT chr, e, translate(reverse(k), 'ATGC', 'TACG'), '-' FROM g WHERE regexp_matches(k, '.[^C]G$')""")(
    lambda s, d: readers.scan_motifs(s.createDataFrame(_FASTA, "ord bigint, value string"), "CHN"))
query("event_tumbling", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda s, d: ingest.event_windows(table(s, d, "events")).withColumn("total", F.round("total", 4)))
query("event_sessions", """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, g""")(lambda s, d: ingest.event_sessions(table(s, d, "events")))
query("running_windows", sql('SELECT cell_id, chr, pos // 1000 * 1000 AS "start", pos // 1000 * 1000 + 1000 AS "end", count(*) FILTER (c <> 0) AS m, count(*) FILTER (t <> 0) AS u, sum(c + t)::BIGINT AS n FROM calls GROUP BY ALL', "calls"))(
    lambda s, d: ingest.running_windows(calls(s, d), 1000))
query("group_cube", sql("SELECT grp, batch, count(*) AS n FROM cells GROUP BY CUBE (grp, batch)", "cells"))(lambda s, d: cells(s, d).cube("grp", "batch").agg(F.count("*").alias("n")))
