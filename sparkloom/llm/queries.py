"""All queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import bbit_minhash, fm_decontam, line_templates, norm_search, packing, quality_ledger, secret_links, simhash_vptree, suffix_dedup, token_matrix, token_rollup, turn_repair, url_templates

_MODULES = (bbit_minhash, fm_decontam, line_templates, norm_search, packing, quality_ledger, secret_links, simhash_vptree, suffix_dedup, token_matrix, token_rollup, turn_repair, url_templates)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
