"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, bpe, licenses, media, mixing, ngram_join, quality, secrets, toxicity, urls

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_license_scans": licenses.op7_license_scans,
    "op7_license_lines": licenses.op7_license_lines,
    "op8_ann_search": ann.op8_ann_search,
    "op9_url_filters": urls.op9_url_filters,
    "op10_bpe_codec": bpe.op10_bpe_codec,
}

SQL = {
    "op1_media_columns": media.OP1_SQL,
    "op2_ngram_jaccard_join": ngram_join.OP2_SQL,
    "op4_secret_scans": secrets.OP4_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op7_license_scans": licenses.OP7_SQL,
    "op7_license_lines": licenses.OP7_LINES_SQL,
    "op8_ann_search": ann.OP8_SQL,
}
