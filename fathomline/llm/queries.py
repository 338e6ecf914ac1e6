"""The queries of this subpackage and their SQL, for the registry at the top of the repository."""

from __future__ import annotations

from . import bpe, fingerprints, html, jaccard, language, lines, nearest, packing, sharding, warc
from .oracles import ORACLES

QUERIES = {
    "op1_warc_index_first": warc.query,
    "op2_site_templates": html.query,
    "op3_string_kernels": language.query,
    "op4_byte_bpe": bpe.query,
    "op5_nnls_packing": packing.query,
    "op8_vantage_point_trees": nearest.query,
    "op9_prefix_tree_join": jaccard.query,
    "op10_piecewise_fingerprints": fingerprints.query,
    "op6_line_similarity_join": lines.query,
    "op7_vector_bin_packing": sharding.query,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
