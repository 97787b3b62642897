"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import chat_events, content_sort, divergence, host_quality, merkle, minhash, mixing, ngram_join, pieces, quality_model, secret_forest, token_counts, token_files


def queries() -> dict:
    return {
        "op1_host_quality": host_quality.op1_host_quality,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_chat_events": chat_events.op3_chat_events,
        "op4_mixing": mixing.op4_mixing,
        "op5_token_files": token_files.op5_token_files,
        "op6_content_sort": content_sort.op6_content_sort,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_pieces": pieces.op8_pieces,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_secret_forest": secret_forest.op10_secret_forest,
        "op11_minhash": minhash.op11_minhash,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_host_quality": host_quality.OP1_SQL,
        "op3_chat_events": chat_events.OP3_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op6_content_sort": content_sort.OP6_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
