"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import ann, lines, merkle, packing, pieces, pii, quality, repair, secrets, simhash, store, topk, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_warc": warc.op2_warc,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_token_store": store.op7_token_store,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_pii": pii.op9_pii,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_nearest": ann.op12_nearest,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op4_exact_top_k": topk.OP4_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_line_dedup": lines.OP10_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_nearest": ann.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
