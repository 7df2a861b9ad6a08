import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake import cli, workspace
from cytolake.operators import cluster, dmr, doublets, matrix, metacells, plotdata, reduce, windows
from cytolake.plans import queries
from cytolake.sources import genomes, readers
from cytolake.streaming import ingest


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    rows = [(f"chr1_{f * 1000}_{f * 1000 + 1000}", f"c{c}", float((c % 3) * 20 + rng.normal(0, 1))) for f in range(12) for c in range(18) if (f + c) % 5]
    m = spark.createDataFrame(rows, "feature string, cell_id string, value double")
    cells = spark.createDataFrame([(f"c{c}", f"g{c % 3}", 10 + c) for c in range(18)], "cell_id string, grp string, cov int")
    return m, cells


def test_minimum_values_are_strict(spark):
    m = spark.createDataFrame([("f", f"c{i}", 1.0) for i in range(5)], "feature string, cell_id string, value double")
    groups = spark.createDataFrame([(f"c{i}", "g") for i in range(6)], "cell_id string, grp string")
    assert matrix.aggregate_matrix(m, groups, 5, 5).count() == 0
    assert matrix.aggregate_matrix(m, groups, 5, 4).count() == 1


def test_upsert(spark):
    schema = "chr string, start bigint, end bigint, grp string, pct double"
    old, new = spark.createDataFrame([("chr1", 0, 10, "a", 1.0)], schema), spark.createDataFrame([("chr1", 0, 10, "a", 2.0), ("chr1", 10, 20, "a", 3.0)], schema)
    values = lambda df: sorted(r.pct for r in df.collect())
    assert values(workspace.upsert_track(old, new)) == [1.0, 3.0]
    assert values(workspace.upsert_track(old, new, force=True)) == [2.0, 3.0]
    assert workspace.missing_windows(new, old).count() == 1


def test_prefixes_keep_values_apart(spark, small):
    m, cells = small
    both = workspace.combine([workspace.Workspace(cells=cells, matrices={"m": m}).add_prefix(p) for p in ("1_", "2_")])
    assert both.matrices["m"].count() == 2 * m.count()
    one = both.matrices["m"].where(F.col("cell_id").startswith("1_")).select("feature", F.expr("substr(cell_id, 3)").alias("cell_id"), "value")
    assert one.exceptAll(m).count() == 0 and m.exceptAll(one).count() == 0
    assert both.subset(both.cells.where("grp = 'g0'")).cells.count() == 12


def test_metadata_and_legacy_tables(spark, small):
    _, cells = small
    more = spark.createDataFrame([("c0", 99)], "cell_id string, cov int")
    joined = workspace.add_metadata(cells, more)
    assert {"cov.x", "cov.y"} <= set(joined.columns) and joined.count() == 18
    with pytest.raises(ValueError):
        workspace.add_metadata(cells, more.where("false"))
    old = workspace.convert_legacy({"h5paths": spark.createDataFrame([("b", "p")], "barcode string, paths string"), "metadata": cells.withColumn("umap_x", F.lit(1.0)).withColumn("umap_y", F.lit(2.0)), "cg_tracks": more})
    assert old.paths.columns == ["barcode", "path"] and "umap" in old.reductions and "cg_tracks" in old.tracks and "umap_x" not in old.cells.columns


def test_readers(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("a\t1\t2\t70.5\t3\t1.5\n")
    assert readers.read_cell_info(spark, str(tmp_path / "info.tsv")).first().mcg_pct == 70.5
    (tmp_path / "x.bed").write_text("chr1\t1\t5\nchr1\t1\t5\n")
    assert readers.read_bed(spark, str(tmp_path / "x.bed")).count() == 1
    (tmp_path / "y.bed").write_text("chr1\t1\t5\tname\n")
    with pytest.raises(ValueError):
        readers.read_bed(spark, str(tmp_path / "y.bed"))
    (tmp_path / "g.gtf").write_text('#c\nchr1\tS\tgene\t5\t9\t.\t+\t.\tgene_id "X"; gene_name "ABC"; level 2\nchr1\tS\texon\t5\t6\t.\t+\t.\tgene_id "X"\n')
    rows = readers.read_gtf(spark, str(tmp_path / "g.gtf")).orderBy("ord").collect()
    assert [(r.gene_name, r.location) for r in rows] == [("ABC", "chr1_5_9"), (None, "chr1_5_6")]
    (tmp_path / "w.csv").write_text("end,chr,start\n9,chr1,2\n")
    assert readers.read_windows_csv(spark, str(tmp_path / "w.csv")).first() == ("chr1", 2, 9)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 0.5\n2 2 0.7\n")
    (tmp_path / "f.tsv").write_text("w1\nw2\n")
    (tmp_path / "c.csv").write_text("cell_id,pass\na,pass\nz,fail\nb,pass\n")
    got = readers.read_scale_matrix(spark, *(str(tmp_path / n) for n in ("m.mtx", "f.tsv", "c.csv"))).collect()
    assert sorted(map(tuple, got)) == [("w1", "a", 0.5), ("w2", "b", 0.7)]


def test_motifs(spark):
    fasta = spark.createDataFrame([(0, ">chr desc"), (1, "AC"), (2, "GT")], "ord bigint, value string")
    assert sorted(map(tuple, readers.scan_motifs(fasta).collect())) == [("chr", 2, "CG", "+"), ("chr", 3, "CG", "-")]


@pytest.mark.parametrize("kind", ["CG", "CHN"])
def test_motifs_do_not_depend_on_splits(spark, kind):
    rng = np.random.default_rng(6)
    lines = [">a x"] + ["".join(rng.choice(list("ACGTN"), rng.integers(2, 9))) for _ in range(12)] + [">b", "", "CC", "GGC"] + [">c"] + ["".join(rng.choice(list("cgAT"), 5)) for _ in range(9)]
    whole = [(i, v) for i, v in enumerate(lines)]
    cuts = [(min(i // 4, 5) << 33 | i, v) for i, v in enumerate(lines)]
    scan = lambda rows: sorted(map(tuple, readers.scan_motifs(spark.createDataFrame(rows, "ord bigint, value string"), kind).collect()))
    want = []
    for name, seq in {"a": "".join(lines[1:13]), "b": "CCGGC", "c": "".join(lines[18:])}.items():
        seq = "N" * 2 + seq.upper()
        for e in range(2, len(seq)):
            g = seq[e - 1 : e + 1] if kind == "CG" else seq[e - 2 : e + 1]
            if kind == "CG":
                want += [(name, e - 2, g, "+"), (name, e - 1, g, "-")] if g == "CG" else []
            else:
                want += [(name, e - 3, g, "+")] if g[0] == "C" and g[1] != "G" else []
                want += [(name, e - 1, g[::-1].translate(str.maketrans("ATGC", "TACG")), "-")] if g[1] != "C" and g[2] == "G" else []
    assert scan(whole) == scan(cuts) == sorted(want)


def test_genomes_and_grid(spark):
    sizes = genomes.chromosome_sizes(spark, "hg38")
    assert sizes.count() == 24
    last = windows.genome_grid(sizes.where("chr = 'chr21'"), 1_000_000).orderBy(F.desc("start")).first()
    assert (last.start, last.end) == (46_000_000, 46_709_983)


def test_job_file(spark):
    members = spark.createDataFrame([("MC1", "a"), ("MC1", "b")], "metacell_id string, cell_id string")
    paths = spark.createDataFrame([("a", "A", "/p"), ("b", "B", "/p")], "cell_id string, barcode string, path string")
    grid = spark.createDataFrame([("chr1", 0, 100), ("chr1", 100, 150)], "chr string, start bigint, end bigint")
    job = json.loads(metacells.job_spec(members, paths, grid).first().value)
    assert job["chrom_sizes"] == {"chr1": 150} and [m["barcode"] for m in job["metacells"]["MC1"]] == ["A", "B"]


def test_svd_against_numpy(spark, small):
    m, cells = small
    dense = m.toPandas().pivot(index="feature", columns="cell_id", values="value").fillna(0).to_numpy()
    assert reduce.singular_values(m, cells, 5) == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:5])
    e = reduce.truncated_svd({"m": m}, cells, {"m": 3})
    x = np.array([r.vec for r in e.orderBy("cell_id").collect()])
    assert x.T @ x == pytest.approx(np.eye(3), abs=1e-9)
    assert reduce.estimate_dims(m, cells, 12, 0.5) == 1


@pytest.mark.parametrize("fill", [0.0, 1.5, "cov"])
def test_svd_beyond_the_bound_of_the_gram_matrix(spark, small, monkeypatch, fill):
    m, cells = small
    want, near = reduce.singular_values(m, cells, 5, fill), reduce.truncated_svd({"m": m}, cells, {"m": 3}, {"m": fill})
    monkeypatch.setattr(reduce, "GRAM_CELLS", 10)
    assert reduce.singular_values(m, cells, 5, fill) == pytest.approx(want)
    x, y = (np.array([r.vec for r in e.orderBy("cell_id").collect()]) for e in (near, reduce.truncated_svd({"m": m}, cells, {"m": 3}, {"m": fill})))
    assert y == pytest.approx(x, abs=1e-6)
    assert reduce.singular_values(m.limit(0), cells, 5) == pytest.approx(np.zeros(5))


def test_svd_of_many_singular_values_that_are_nearly_equal(spark, monkeypatch):
    rng = np.random.default_rng(3)
    one = rng.random((8, 6)) * (rng.random((8, 6)) < 0.8)
    rows = [(f"f{copy}_{f}", copy * 6 + c, float(one[f, c] * (1 + copy * 1e-9))) for copy in range(60) for f in range(8) for c in range(6) if one[f, c]]
    m, cells = spark.createDataFrame(rows, "feature string, cell_id bigint, value double"), spark.range(360).select(F.col("id").alias("cell_id"))
    monkeypatch.setattr(reduce, "GRAM_CELLS", 10)
    monkeypatch.setattr(reduce, "CHUNK", 100, raising=False)
    ids, sigma, v = reduce.top_singular(m, cells, 5)
    assert sigma == pytest.approx(np.full(5, np.linalg.svd(one, compute_uv=False)[0]), rel=1e-6)
    assert v.T @ v == pytest.approx(np.eye(5), abs=1e-9) and ids == list(range(360))


def test_svd_of_many_equal_singular_values(spark, monkeypatch):
    values = [1.0] * 60 + np.linspace(0.01, 0.9, 100).tolist()
    m = spark.createDataFrame([(f"f{i}", i, x) for i, x in enumerate(values)], "feature string, cell_id bigint, value double")
    monkeypatch.setattr(reduce, "GRAM_CELLS", 10)
    assert reduce.singular_values(m, m.select("cell_id"), 5) == pytest.approx(np.ones(5))


@pytest.mark.parametrize("fill", [0.0, 1.5, "cov"])
def test_imputation_beyond_the_bound(spark, small, fill):
    m, cells = small
    m = m.where("cell_id <> 'c3'").unionByName(spark.createDataFrame([("chr9_0_1000", "elsewhere", 3.0)], m.schema))  # one cell without values, one feature without cells
    want, got = ({(r.feature, r.cell_id): r.value for r in reduce.impute(m, cells, 4, fill, limit=n).collect()} for n in (5000, 10))
    assert len(got) == 13 * 18 and got == pytest.approx(want, abs=1e-6)


def test_residuals_do_not_follow_coverage(spark, small):
    _, cells = small
    e = cells.select("cell_id", F.array(F.ln(F.col("cov").cast("double")) * 3 + 1, F.col("cov").cast("double")).alias("vec"))
    x = np.array([r.vec for r in reduce.regress_out(e, cells).collect()])
    assert np.abs(x[:, 0]).max() < 1e-8
    assert np.abs(np.array([r.vec for r in reduce.regress_out(e, cells, knots=2).collect()])[:, 1]).max() < 0.5


def blobs(spark, n=90):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (n, 3)) + np.eye(3)[np.arange(n) % 3] * 5
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id bigint, vec array<double>")


@pytest.mark.parametrize(("method", "resolution"), [("louvain", 1.0), ("leiden", 0.05)])
def test_communities_find_blobs(spark, method, resolution):
    got = {r.cell_id: r.cluster_id for r in cluster.cluster_cells(blobs(spark), 10, method, resolution).collect()}
    blob_of = {}
    for cell, name in got.items():
        assert blob_of.setdefault(name, cell % 3) == cell % 3
    assert len(got) == 90 and 3 <= len(blob_of) <= 9


@pytest.mark.parametrize("layout", [reduce.tsne, reduce.umap])
def test_layouts_keep_neighbours(spark, layout):
    rows = layout(blobs(spark), 10, rounds=150).orderBy("cell_id").collect()
    xy = np.array([(r.dim_x, r.dim_y) for r in rows])
    assert np.isfinite(xy).all()
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1) + np.eye(90) * 1e9
    assert (d.argmin(1) % 3 == np.arange(90) % 3).mean() > 0.95


@pytest.mark.parametrize("layout", [reduce.tsne, reduce.umap])
def test_layouts_beyond_the_bound_keep_neighbours(spark, layout):
    rows = layout(blobs(spark), 10, rounds=150, limit=20).orderBy("cell_id").collect()
    xy = np.array([(r.dim_x, r.dim_y) for r in rows])
    assert len(xy) == 90 and np.isfinite(xy).all()
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1) + np.eye(90) * 1e9
    assert (d.argmin(1) % 3 == np.arange(90) % 3).mean() > 0.95


@pytest.mark.parametrize("mode", ["knn", "dbscan", "adaptive"])
def test_metacells_hold_every_cell(spark, mode):
    got = metacells.make_metacells(blobs(spark), 10, mode=mode)
    assert {r.cell_id for r in got.collect()} == set(range(90))
    mixed = got.groupBy("metacell_id").agg(F.count_distinct(F.col("cell_id") % 3).alias("k"))
    assert mixed.where("k > 1").count() <= 2


@pytest.mark.parametrize("mode", ["knn", "dbscan", "adaptive"])
def test_metacells_without_a_table_of_distances(spark, monkeypatch, mode):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), rng.normal(6, 0.3, (100, 4)), rng.uniform(-9, 9, (30, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id bigint, vec array<double>")
    groups = lambda: sorted((r.metacell_id, r.cell_id) for r in metacells.make_metacells(df, 10, mode=mode).collect())
    want = groups()
    monkeypatch.setattr(metacells, "DENSE_ROWS", 20)
    monkeypatch.setattr(reduce, "MAX_CELLS", 20)
    monkeypatch.setattr(reduce.gather, "__defaults__", (20,))
    assert groups() == want


def test_imputation_and_refilling():
    rng = np.random.default_rng(3)
    low = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 15))
    holes = low.copy()
    holes[rng.random(low.shape) < 0.1] = np.nan
    _, full = reduce.iterative_pca(holes, 2, 1e-6, 500)
    assert np.abs(full - low)[np.isnan(holes)].mean() < 0.1
    assert reduce.diffuse(np.ones((9, 4)), 2) == pytest.approx(np.ones((9, 4)))


def test_doublets(spark, small):
    m, cells = small
    both, flags = doublets.simulated(m, cells, 0.5)
    assert flags.where("artificial").count() == 9 and both.count() > m.count()
    again, _ = doublets.simulated(m, cells, 0.5)
    assert both.exceptAll(again).count() == 0


def test_markers(spark, small):
    m, cells = small
    out = dmr.cluster_markers(m, cells, nmin=3).collect()
    top = [r for r in out if r.grp == "g2"]
    assert all(r.direction == "hypermethylated" and 0 <= r.p_val <= r.p_adj <= 1 for r in top) and top


def test_palettes():
    assert len(plotdata.PALETTES) == 30
    assert plotdata.palette("toucan", 2, sample=False) == ["#150808", "#ec5151"]
    grown = plotdata.palette(3, 7)
    assert len(grown) == 7 and grown[0] == "#150808" and grown[2].lower() == "#ec5151"


def test_blend_needs_two_or_three_genes(spark, small):
    with pytest.raises(ValueError):
        plotdata.blended(small[0], ["a"], small[1])


def test_chromosome_order(spark):
    df = spark.createDataFrame([(c,) for c in ("chrX", "chr10", "chr2", "chrM")], "chr string")
    assert [r.chr for r in df.orderBy(*plotdata.chromosome_order(F.col("chr"))).collect()] == ["chr2", "chr10", "chrM", "chrX"]


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(i % 3, "chr1", i * 137 % 5000, i % 2, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "cell_id bigint, chr string, pos bigint, c bigint, t bigint")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    q = ingest.running_windows(ingest.stream_calls(spark, str(tmp_path / "in"), 1), 1000).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("running"), ingest.running_windows(df, 1000)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([("CG", "a", "chr1", 5, 1, 0), ("CG", "b", "chr1", 700, 0, 1), ("CH", "a", "chr1", 5, 1, 1)], "context string, cell_id string, chr string, pos bigint, c bigint, t bigint")
    df.write.parquet(str(tmp_path / "calls"))
    (tmp_path / "skip").write_text("b\n")
    cli.main(["agg", str(tmp_path / "calls"), str(tmp_path / "out"), "-u", "500", "-u", "w=1000:500", "-c", "CG", "--skipbc", str(tmp_path / "skip")])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(str(r.name), r.start) for r in out.collect()} == {("500", 0), ("w", 0), ("w", -500)}
    cli.main(["delete", "context", "CH", str(tmp_path / "calls"), str(tmp_path / "less")])
    assert spark.read.parquet(str(tmp_path / "less")).count() == 2
    cli.main(["version"])
    assert capsys.readouterr().out.strip()


def test_whole_bed_reads_every_order_and_the_range_of_the_calls(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in range(1, 150)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 1, 1, 1, 1.0, "R") for k in range(1, 150)], "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    regions = queries.bed(spark, str(tmp_path))
    assert regions.count() == 149 and regions.agg(F.max("start")).first()[0] == 1491
    assert queries.QUERIES["region_merge"](spark, str(tmp_path)).count() == 149
    assert not [n for n, text in queries.SQL.items() if "orderkey % 50 = 0" in text or "cell_id % 3 = 0 GROUP" in text]


def test_layout_and_doublet_queries_use_the_defaults(monkeypatch):
    given = {}
    for where, name in ((reduce, "umap"), (reduce, "tsne"), (doublets, "fit_model")):
        monkeypatch.setattr(where, name, lambda *a, _n=name, **k: given.update({_n: k}) or (None, None))
    for where, name in ((queries, "embedding"), (queries, "mat"), (queries, "cells"), (reduce, "truncated_svd"), (doublets, "scores")):
        monkeypatch.setattr(where, name, lambda *a: None)
    monkeypatch.setattr(doublets, "simulated", lambda *a: (None, None))
    for name in ("umap", "tsne", "doublet_scores"):
        queries.QUERIES[name](None, "")
    assert given == {"umap": {}, "tsne": {}, "fit_model": {}}


def test_matrix_entries_like_the_header_stay(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% a comment\n3 3 3\n3 3 3\n1 1 2\n3 3 3\n")
    (tmp_path / "f.tsv").write_text("x\ny\nz\n")
    (tmp_path / "c.csv").write_text("cell_id,pass\na,pass\nb,pass\nc,pass\n")
    got = readers.read_scale_matrix(spark, *(str(tmp_path / n) for n in ("m.mtx", "f.tsv", "c.csv"))).collect()
    assert sorted(map(tuple, got)) == [("x", "a", 2.0), ("z", "c", 3.0), ("z", "c", 3.0)]


def test_samples_side_by_side(spark, tmp_path):
    """Zeros within a sample, nothing where its features lack a window; cells that do not pass have no column."""
    import gzip

    (tmp_path / "genome_bin_matrix").mkdir()
    for sample, feats, cells, entries in (("s1", "w1\nw2\n", "a,pass,A\nx,fail,A\nb,pass,B\n", "2 2 2\n1 1 5\n2 2 6\n"), ("s2", "w2\nw3\n", "c,pass,A\n", "2 1 1\n2 1 7\n")):
        (tmp_path / f"{sample}.allCells.csv").write_text("cell_id,pass,tgmt_well\n" + cells)
        (tmp_path / "genome_bin_matrix" / f"{sample}.CG.features.tsv").write_text(feats)
        with gzip.open(tmp_path / "genome_bin_matrix" / f"{sample}.CG.score.mtx.gz", "wt") as f:
            f.write("%%MatrixMarket\n" + entries)
    w = workspace.read_scale_workspace(spark, str(tmp_path), ["CG.score"])
    assert sorted(map(tuple, w.matrices["CG.score"].collect())) == [("w1", "a", 5.0), ("w1", "b", 0.0), ("w2", "a", 0.0), ("w2", "b", 6.0), ("w2", "c", 0.0), ("w3", "c", 7.0)]
    assert sorted(r.cell_id for r in w.cells.collect()) == ["a", "b", "c"]
    assert {r.barcode: r.path for r in w.paths.collect()}["b"] == f"{tmp_path}/methylation_coverage/amethyst/s1/s1.B_cov.h5"
    assert readers.read_scale_samples(spark, str(tmp_path), "CG.score", zeros=False).count() == 3


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(100).repartition(7).sortWithinPartitions("id")
    got = [r.n for r in readers.numbered(df, "n").collect()]
    assert sorted(got) == list(range(1, 101))


def test_delete_keeps_rows_without_a_context(spark, tmp_path):
    df = spark.createDataFrame([("CG", "a"), (None, "b"), ("CH", "c")], "context string, cell_id string")
    df.write.parquet(str(tmp_path / "calls"))
    cli.main(["delete", "context", "CH", str(tmp_path / "calls"), str(tmp_path / "less")])
    assert {r.cell_id for r in spark.read.parquet(str(tmp_path / "less")).collect()} == {"a", "b"}


def test_motifs_across_short_splits_and_files(spark):
    """Splits of one base, and a second file that begins without a header line."""
    part = lambda n, i: (n << 33) + i
    rows = [(part(0, 0), "f1", ">chr1"), (part(0, 1), "f1", "AAC"), (part(1, 0), "f1", "C"), (part(2, 0), "f1", "T"), (part(3, 0), "f1", "ACG"), (part(4, 0), "f2", "GTC"), (part(5, 0), "f2", ">chr2"), (part(5, 1), "f2", "CAA")]
    df = spark.createDataFrame(rows, "ord bigint, file string, value string")
    whole = spark.createDataFrame([(0, ">chr1"), (1, "AACCTACG"), (2, ">chr2"), (3, "CAA")], "ord bigint, value string")
    for kind in ("CG", "CHN"):
        got = [tuple(r) for r in readers.scan_motifs(df, kind).where("chr is not null").collect()]
        assert sorted(got) == sorted(map(tuple, readers.scan_motifs(whole, kind).collect()))


def test_annotation_of_several_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("c1\tT\t1\nc2\tB\t2\n")
    assert [tuple(r) for r in readers.read_annotation(spark, str(tmp_path / "a.tsv"), "type", "batch").collect()] == [("c1", "T", "1"), ("c2", "B", "2")]
    with pytest.raises(ValueError):
        readers.read_annotation(spark, str(tmp_path / "a.tsv"), "type")


def test_calls_and_windows_in_partitions(spark, tmp_path):
    calls = spark.createDataFrame([("CG", "a", "chr1", 5, 1, 0), ("CG", "a", "chr2", 7, 0, 1), ("CH", "a", "chr1", 5, 1, 1)], "context string, cell_id string, chr string, pos bigint, c bigint, t bigint")
    readers.write_calls(calls, str(tmp_path / "calls"))
    got = readers.read_calls(spark, str(tmp_path / "calls"), "CG", ["chr1"])
    assert got.count() == 1 and "PartitionFilters: [isnotnull(context" in got._jdf.queryExecution().toString()
    win = calls.withColumn("name", F.col("chr"))
    readers.write_aggregated(win, str(tmp_path / "win"))
    assert readers.read_aggregated(spark, str(tmp_path / "win"), "chr1").count() == 2
    assert readers.read_aggregated(spark, str(tmp_path / "win"), "chr1", "CH").first().t == 1


def test_saved_tables_go_on_as_they_were(spark, tmp_path):
    calls = spark.createDataFrame([(f"c{i % 3}", f"chr{i % 2 + 1}", i * 100, i % 2, 1 - i % 2) for i in range(60)], "cell_id string, chr string, pos bigint, c bigint, t bigint")
    cells = spark.createDataFrame([(f"c{i}", f"g{i % 2}") for i in range(3)], "cell_id string, grp string")
    plain, kept = (windows.make_windows(calls, stepsize=1000, save=p) for p in (None, str(tmp_path / "w")))
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect())) and (tmp_path / "w" / "chr=chr1").exists()
    plain, kept = (windows.smoothed_windows(calls, cells, save=p) for p in (None, str(tmp_path / "s")))
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect()))


def test_populating_a_track(spark):
    schema = "chr string, start bigint, end bigint, grp string, pct double"
    wins = spark.createDataFrame([("chr1", i * 100, i * 100 + 100, "g", float(i)) for i in range(20)], schema)
    have = spark.createDataFrame([("chr1", 500, 600, "g", -1.0)], schema)
    ranges = spark.createDataFrame([("chr1", 400, 800)], "chr string, start bigint, end bigint")
    values = lambda df: {r.start: r.pct for r in df.collect()}
    assert values(workspace.populate_track(have, wins, regions=ranges)) == {400: 4.0, 500: -1.0, 600: 6.0, 700: 7.0}
    assert values(workspace.populate_track(have, wins, regions=ranges, force=True)) == {400: 4.0, 500: 5.0, 600: 6.0, 700: 7.0}
    genes = spark.createDataFrame([("chr1", 600, 700, "G", "+", 1)], "chr string, start bigint, end bigint, gene_name string, strand string, ord long")
    assert values(workspace.populate_track(None, wins, genes, ["G"], overhang=100)) == {500: 5.0, 600: 6.0, 700: 7.0}
    with pytest.raises(ValueError):
        workspace.populate_track(have, wins.drop("pct"), regions=ranges)
    with pytest.raises(ValueError):
        workspace.populate_track(have, wins, genes)


def test_refinement_keeps_communities_connected():
    """Blobs come out whole, and every community of the refined search hangs together."""
    rng = np.random.default_rng(3)
    n, edges = 60, set()
    for g in range(3):
        own = range(g * 20, g * 20 + 20)
        edges |= {(a, b) for a in own for b in own if a < b and rng.random() < 0.5}
    edges |= {(0, 20), (25, 45)}
    i, j = np.array(sorted(edges)).T
    label = cluster.communities(n, i, j, np.ones(len(i)), 0.2, "cpm", refine=True)
    assert len(set(label.tolist())) == 3 and all(len(set(label[g * 20 : g * 20 + 20].tolist())) == 1 for g in range(3))
