"""The tables that plots are drawn from, and colour palettes."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import gene_ranges, windows_within


def composition(cells: DataFrame, group: str, colour: str) -> DataFrame:
    """group, colour, n, share of each colour within its group."""
    counts = cells.groupBy(group, colour).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def dim_points(cells: DataFrame, layout: DataFrame, seed: int = 123) -> DataFrame:
    """Metadata and coordinates of the cells in both, in an order that hides none (by hash of seed and id)."""
    return cells.join(layout, "cell_id").orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id")


def dim_labels(cells: DataFrame, layout: DataFrame, label: str) -> DataFrame:
    """label, x, y: where each label is written."""
    return cells.join(layout, "cell_id").groupBy(label).agg(F.avg("dim_x").alias("x"), F.avg("dim_y").alias("y"))


def dim_values(matrix: DataFrame, genes: list[str], cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Values of genes with metadata and coordinates of their cells."""
    return matrix.where(F.col("feature").isin(genes)).where("value is not null").join(cells, "cell_id").join(layout, "cell_id")


def blended(matrix: DataFrame, genes: list[str], layout: DataFrame) -> DataFrame:
    """cell_id, dim_x, dim_y, mix: two or three genes' values as red, green and blue of #RRGGBB, scaled to the largest."""
    if len(genes) not in (2, 3):
        raise ValueError("blending takes 2 or 3 genes")
    chosen = matrix.where(F.col("feature").isin(genes))
    top = chosen.agg(F.max("value")).first()[0]
    by_cell = chosen.groupBy("cell_id").pivot("feature", genes).agg(F.first("value")).dropna()
    hexed = [F.format_string("%02X", F.round(F.try_divide(F.col(f"`{g}`"), F.lit(top)) * 255).cast("int")) for g in genes] + [F.lit("00")] * (3 - len(genes))
    return by_cell.withColumn("mix", F.concat(F.lit("#"), *hexed)).join(layout, "cell_id").select("cell_id", "dim_x", "dim_y", "mix")


def violin_values(matrix: DataFrame, genes: list[str], cells: DataFrame, group: str) -> DataFrame:
    return matrix.where(F.col("feature").isin(genes)).join(cells.select("cell_id", group), "cell_id").select("feature", "cell_id", group, "value")


def dot_means(sizes: DataFrame, colours: DataFrame, genes: list[str], cells: DataFrame, group: str, split: str | None = None) -> DataFrame:
    """group (and split), feature, mean_size, mean_colour over cells with both values."""
    a = sizes.where(F.col("feature").isin(genes)).select("feature", "cell_id", F.col("value").alias("s_"))
    b = colours.where(F.col("feature").isin(genes)).select("feature", "cell_id", F.col("value").alias("c_"))
    by = [group] + ([split] if split else [])
    return a.join(b, ["feature", "cell_id"]).join(cells.select("cell_id", *by), "cell_id").groupBy(*by, "feature").agg(F.avg("s_").alias("mean_size"), F.avg("c_").alias("mean_colour"))


def track_values(track: DataFrame, ranges: DataFrame, overhang: int = 0, baseline: bool = False, subset: str | None = None) -> DataFrame:
    """Rows of a long track (chr, start, end, grp, pct) that lie in the ranges, with their middle and, for a baseline,
    their group's mean over the whole track. subset: a regular expression that a group's name must match somewhere."""
    track = track.where(F.col("grp").rlike(subset)) if subset else track
    wide = ranges.select("chr", F.greatest(F.lit(0), F.col("start") - overhang).alias("start"), (F.col("end") + overhang).alias("end"))
    inside = windows_within(track, wide).withColumn("middle", (F.col("start") + F.col("end")) / 2)
    return inside.join(track.groupBy("grp").agg(F.avg("pct").alias("glob_m")), "grp", "left") if baseline else inside


def gene_track(track: DataFrame, genes: DataFrame, names: list[str], overhang: int = 5000, baseline: bool = True, subset: str | None = None) -> DataFrame:
    """The same around genes, by their longest rows."""
    return track_values(track, gene_ranges(genes.where(F.col("gene_name").isin(names)), overhang), 0, baseline, subset)


def gene_layers(genes: DataFrame, names: list[str], reach: int = 1500) -> DataFrame:
    """layer (gene, exon, promoter), chr, start, end, gene_name, strand of the named genes; genes has a type column."""
    own = genes.where(F.col("gene_name").isin(names))
    bodies = own.where(F.col("type").isin("gene", "exon")).select(F.col("type").alias("layer"), "chr", "start", "end", "gene_name", "strand")
    tss = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    promoter = own.where("type = 'gene'").select(F.lit("promoter").alias("layer"), "chr", (tss - reach).alias("start"), (tss + reach).alias("end"), "gene_name", "strand")
    return bodies.unionByName(promoter)


def colour_range(values: DataFrame, column: str = "pct") -> DataFrame:
    """low, high of the scale: 0-100 if the mean is above 10; else 0 to the 99.9th percentile; -1 to 1 for values below 0."""
    s = values.agg(F.avg(column).alias("m"), F.min(column).alias("lo"), F.percentile(column, F.lit(0.999)).alias("q"))
    score = (F.col("lo") < 0) & (F.col("m") <= 10)
    return s.select(F.when(score, -1.0).otherwise(0.0).alias("low"), F.when(F.col("m") > 10, 100.0).when(score, 1.0).otherwise(F.col("q")).alias("high"))


def chromosome_order(name: Column) -> list[Column]:
    """Sort keys that put chr2 before chr10, and letters last."""
    tail = F.regexp_replace(name, "^chr", "")
    number = F.when(tail.rlike("^[0-9]{1,9}$"), tail).cast("int")
    return [F.coalesce(number, F.lit(1 << 30)), tail]


def genome_heat(matrix: DataFrame, max_columns: int = 1000) -> DataFrame:
    """chr, start, end, grp, value and chr_rank of a matrix by group whose features are chr_start_end."""
    groups = matrix.select("grp").distinct().limit(max_columns + 1).count()
    if groups > max_columns:
        raise ValueError(f"more than {max_columns} groups: aggregate first")
    parts = F.split("feature", "_")
    placed = matrix.select(parts[0].alias("chr"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"), "grp", "value")
    order = placed.select("chr").distinct().withColumn("chr_rank", F.row_number().over(Window.orderBy(*chromosome_order(F.col("chr")))))
    return placed.join(order, "chr")


def metacell_points(members: DataFrame, layout: DataFrame, meta_layout: DataFrame) -> DataFrame:
    """Each member cell's coordinates beside its metacell's."""
    meta = meta_layout.select(F.col("cell_id").alias("metacell_id"), F.col("dim_x").alias("meta_x"), F.col("dim_y").alias("meta_y"))
    return members.join(layout, "cell_id").join(meta, "metacell_id")


def ward_order(x: np.ndarray) -> list[int]:
    """Leaf order of Ward's clustering (squared update) of rows by 1 - correlation, missing values as 0."""
    x = np.nan_to_num(x)
    n = len(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = (1 - np.nan_to_num(np.corrcoef(x))) ** 2 if n > 1 else np.zeros((n, n))
    np.fill_diagonal(d, np.inf)
    leaves, size, live = {i: [i] for i in range(n)}, np.ones(n), set(range(n))
    while len(live) > 1:
        rows = sorted(live)
        sub = d[np.ix_(rows, rows)]
        a, b = (rows[i] for i in np.unravel_index(int(sub.argmin()), sub.shape))
        a, b = min(a, b), max(a, b)
        for k in live - {a, b}:
            total = size[a] + size[b] + size[k]
            d[a, k] = d[k, a] = ((size[a] + size[k]) * d[a, k] + (size[b] + size[k]) * d[b, k] - size[k] * d[a, b]) / total
        leaves[a] += leaves.pop(b)
        size[a] += size[b]
        live.discard(b)
    return leaves[min(live)] if live else []


def meta_map(track: DataFrame, ranges: DataFrame, cluster: bool = True, max_rows: int = 2000) -> DataFrame:
    """The heat map's rows with row_order: metacells by clustering of their values in the ranges, or by name."""
    values = track_values(track, ranges)
    names = [r.grp for r in values.select("grp").distinct().orderBy("grp").limit(max_rows + 1).collect()]
    if len(names) > max_rows:
        raise ValueError(f"more than {max_rows} metacells")
    order = list(range(len(names)))
    if cluster and len(names) > 2:
        rows = values.select("grp", "chr", "start", "pct").collect()
        cols = {k: i for i, k in enumerate(sorted({(r.chr, r.start) for r in rows}))}
        x = np.full((len(names), len(cols)), np.nan)
        place = {g: i for i, g in enumerate(names)}
        for r in rows:
            x[place[r.grp], cols[r.chr, r.start]] = np.nan if r.pct is None else r.pct
        order = ward_order(x)
    ranks = track.sparkSession.createDataFrame([(names[g], i + 1) for i, g in enumerate(order)], "grp string, row_order int")
    return values.join(ranks, "grp")


#: Named palettes. "mistyrose1" is #FFE4E1.
PALETTES = {
    "pool_party": ["#004A4A", "#419e9e", "#75C8D2", "#aae3e3", "#cfe3dc", "#d4c8b2", "#FFE4E1", "#ffdea3", "#FFD554", "#fcba2b", "#FFA976", "#FF8B73", "#F05252", "#bd083e"],
    "kingfisher": ["#d84c4b", "#15485d", "#439f9e", "#f2e5dd", "#f08e29", "#df431a"],
    "toucan": ["#150808", "#ec5151", "#ffdd6d", "#a8dadc"],
    "ice_pop": ["#293241", "#3d5a80", "#98c1d9", "#e0fbfc", "#ee6c4d"],
    "sushi_roll": ["#00050b", "#0b704e", "#6f9d80", "#e1e9d1", "#fb8b01", "#f34509"],
    "autumn_hike": ["#3D7577", "#4A4B1F", "#BDBEBF", "#F69E09", "#E32D12", "#540101"],
    "lupine_field": ["#B5DCA5", "#F9AB60", "#E7576E", "#630661", "#220D50"],
    "resplendent_quetzal": ["#0D353F", "#72CDAE", "#E6DAC6", "#F5562A", "#AB2E44"],
    "iris_garden": ["#611c35", "#a63446", "#f44e3f", "#ffa630", "#f3d9dc", "#d1c8e1", "#2e5077", "#373f51", "#4da1a9", "#B4DDE1"],
    "betta": ["#fd5145", "#ff7165", "#ffbaa4", "#87d0bf", "#157d88", "#043E44"],
    "northern_lights": ["#FBD8B0", "#DCF2C4", "#74DFD5", "#134077", "#DF4275"],
    "wood_duck": ["#c05761", "#734f5a", "#264653", "#2a9d8f", "#e9c46a", "#f4a261", "#e76f51", "#941c2f"],
    "caique": ["#264653", "#2a9d8f", "#e9c46a", "#f4a261", "#e76f51"],
    "rum_punch": ["#870022", "#db5375", "#e86c5f", "#f58549", "#f2a65a", "#eec170", "#ccd0b5", "#bbd7d7", "#288989"],
    "macaw": ["#f7b0be", "#ed8e83", "#ef3c23", "#f15a42", "#fac92c", "#cfe5cc", "#2178ae", "#1b4793"],
    "sea_glass": ["#50514f", "#f25f5c", "#ffe066", "#247ba0", "#70c1b3", "#c0e8f9"],
    "pigeon": ["#C5C9BC", "#114F5A", "#D08222", "#402742", "#B69BB2"],
    "rainbow_trout": ["#f7ede2", "#f6bd60", "#f5cac3", "#84a59d", "#f28482"],
    "fiesta": ["#218380", "#73d2de", "#ffbc42", "#d81159", "#8f2d56"],
    "medium_rare": ["#383536", "#361F1C", "#A23226", "#D7412E", "#EDBBBC", "#979296"],
    "sidewalk_chalk": ["#c46c9f", "#f46b72", "#f0898c", "#feb46b", "#fe9e6c", "#acd2c7", "#bed4bd", "#d3cd79"],
    "green_jay": ["#B7CFCF", "#D3C75C", "#8BA2CD", "#E2987B", "#37737D"],
    "koi_pond": ["#50514f", "#f25f5c", "#ffe066", "#247ba0", "#70c1b3", "#c0e8f9"],
    "rose_garden": ["#7EAA9F", "#892B69", "#6E0B1B", "#C61B24", "#EE5C47", "#fcb9ac"],
    "nectarine": ["#7C2C47", "#B4141F", "#DF6C26", "#E9B60D", "#BABC36"],
    "venus_fly_trap": ["#1c5253", "#306b34", "#c3eb78", "#f3ffc6", "#b6174b"],
    "ambrosia_salad": ["#b6e2dd", "#c8ddbb", "#e9e5af", "#fbdf9d", "#fbc99d", "#fbb39d", "#fba09d"],
    "mantis_shrimp": ["#247ba0", "#a15856", "#f25f5c", "#f9a061", "#ffe066", "#92ae83", "#70c1b3", "#4a9eaa", "#50514f"],
    "salmon_fillet": ["#579393", "#A95862", "#FB856C", "#FEB780", "#7D8EA8"],
    "macaron": ["#C0CFE0", "#C5C463", "#F2AF3F", "#FFA090", "#EF5356"],
}


def palette(option: int | str, n: int, sample: bool = True, seed: int | None = None) -> list[str]:
    """n colours of a palette (by name, or by number from 1): drawn, the first ones, or interpolated when there are fewer."""
    colours = PALETTES[option] if isinstance(option, str) else list(PALETTES.values())[option - 1]
    if n < len(colours):
        return random.Random(seed).sample(colours, n) if sample else colours[:n]
    rgb = np.array([[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in colours])
    at = np.linspace(0, len(colours) - 1, n)
    mixed = np.stack([np.interp(at, range(len(colours)), rgb[:, k]) for k in range(3)], 1)
    return ["#{:02X}{:02X}{:02X}".format(*np.floor(c + 0.5).astype(int)) for c in mixed]


def palette_table(spark, n: int | None = None) -> DataFrame:
    """palette, position, colour of all palettes, as a preview draws them."""
    rows = [(name, i + 1, c) for name, cs in PALETTES.items() for i, c in enumerate(palette(name, n, False) if n else cs)]
    return spark.createDataFrame(rows, "palette string, position int, colour string")


def without_axes() -> dict[str, bool]:
    """Settings that hide a plot's axes, for whatever draws it."""
    return dict.fromkeys(("axis_lines", "axis_text", "axis_ticks", "axis_titles", "grid"), False)
