"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from wakeline.llm import alignment, decontamination, html, lm, packing, pii, ranked_search, secret_scan, simhash, suffix, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_best_two_fit": packing.op4_best_two_fit,
    "op5_norm_sorted_topk": topk.op5_norm_sorted_topk,
    "op6_consensus_paths": html.op6_consensus_paths,
    "op7_stupid_backoff": lm.op7_stupid_backoff,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_pii_bootstrapped": pii.op9_pii_bootstrapped,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_byte_owner_alignment": alignment.op12_byte_owner_alignment,
    "op13_secret_ledger": secret_scan.op13_secret_ledger,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op5_norm_sorted_topk": topk.OP5_SQL,
    "op7_stupid_backoff": lm.OP7_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_secret_ledger": secret_scan.OP13_SQL,
}
