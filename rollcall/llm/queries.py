"""The registered queries of this folder and, where SQL can express them, their SQL."""

from rollcall.llm.cws import op8_cws_fingerprints
from rollcall.llm.forest import OP10_SQL, op10_lsh_forest_join
from rollcall.llm.language import op4_ecoc_language
from rollcall.llm.lexical import OP12_SQL, op12_fp_tree_search
from rollcall.llm.lm import op7_lattice_lm
from rollcall.llm.mixing import op2_pareto_mix
from rollcall.llm.neighbours import OP9_SQL, op9_nn_descent
from rollcall.llm.packing import op3_best_fit_packing
from rollcall.llm.pii import op6_contextual_pii
from rollcall.llm.quality import op5_qda_quality
from rollcall.llm.rules import OP11_SQL, op11_hashed_llr_rules
from rollcall.llm.variants import OP13_SQL, op13_reduced_alphabet_variants
from rollcall.llm.warc import OP1_SQL, op1_warc_round_trip

QUERIES = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ecoc_language": op4_ecoc_language,
    "op5_qda_quality": op5_qda_quality,
    "op6_contextual_pii": op6_contextual_pii,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_cws_fingerprints": op8_cws_fingerprints,
    "op9_nn_descent": op9_nn_descent,
    "op10_lsh_forest_join": op10_lsh_forest_join,
    "op11_hashed_llr_rules": op11_hashed_llr_rules,
    "op12_fp_tree_search": op12_fp_tree_search,
    "op13_reduced_alphabet_variants": op13_reduced_alphabet_variants,
}

SQL = {
    "op1_warc_round_trip": OP1_SQL,
    "op9_nn_descent": OP9_SQL,
    "op10_lsh_forest_join": OP10_SQL,
    "op11_hashed_llr_rules": OP11_SQL,
    "op12_fp_tree_search": OP12_SQL,
    "op13_reduced_alphabet_variants": OP13_SQL,
}
