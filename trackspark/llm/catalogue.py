"""Queries of the corpus operators and the SQL of those that SQL can express."""

from . import decontaminate, divergence, exact_dedup, fingerprints, language, line_windows, mixing, near_dedup, personal, repeats, search, token_counts, token_files

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_personal_data": personal.op3_personal_data,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_line_windows": line_windows.op6_line_windows,
    "op7_token_files": token_files.op7_token_files,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_line_windows": line_windows.SQL,
    "op9_mixing": mixing.SQL,
    "op11_ranked_search": search.SQL,
    "op13_source_divergence": divergence.SQL,
}
