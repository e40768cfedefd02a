"""The queries of this subpackage, each over whole tables, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from . import decontaminate, idstore, langid, licenses, linededup, ngram_join, packing, pii, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_best_fit_pack": packing.op6_best_fit_pack,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_find_pii": pii.op9_find_pii,
    "op10_id_files": idstore.op10_id_files,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_exact_top_k": topk.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
}
