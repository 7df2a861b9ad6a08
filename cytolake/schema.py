"""Column types of the long tables that operators exchange, as DDL."""

CALLS = "context string, cell_id string, chr string, pos bigint, c bigint, t bigint"
AGG_WINDOWS = "context string, cell_id string, name string, chr string, start bigint, end bigint, c bigint, t bigint, c_nz bigint, t_nz bigint"
REGIONS = "chr string, start bigint, end bigint"
GENES = "chr string, start bigint, end bigint, type string, strand string, gene_name string, gene_type string, location string, ord bigint"
MATRIX = "matrix string, feature string, cell_id string, value double"
TRACKS = "track string, chr string, start bigint, end bigint, grp string, pct double"
CELL_INFO = ("cell_id string", "cov bigint", "cg_cov bigint", "mcg_pct double", "ch_cov bigint", "mch_pct double", "n_frag bigint", "n_pair bigint", "n_single bigint", "xpct_m double")
