"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import (
    op10_length_histogram,
    op11_toxicity,
    op12_fill_in_middle,
    op13_alignment,
    op1_license_scan,
    op2_suffix_array,
    op3_quality_rules,
    op4_html_extraction,
    op5_suffix_trees,
    op6_lsh_forest,
    op7_hidden_markov,
    op8_hilbert_packing,
    op9_decontamination,
)

_MODULES = (
    op1_license_scan,
    op2_suffix_array,
    op3_quality_rules,
    op4_html_extraction,
    op5_suffix_trees,
    op6_lsh_forest,
    op7_hidden_markov,
    op8_hilbert_packing,
    op9_decontamination,
    op10_length_histogram,
    op11_toxicity,
    op12_fill_in_middle,
    op13_alignment,
)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
