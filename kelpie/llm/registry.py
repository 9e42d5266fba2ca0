"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from kelpie.llm import kd_search, language_id, media, mixing, near_dup, ngram_lm, packing, pii, quality_cnn, url_filter


def queries() -> dict:
    return {
        "op1_superminhash": near_dup.op1_superminhash,
        "op2_backoff_automaton": ngram_lm.op2_backoff_automaton,
        "op3_compression_language": language_id.op3_compression_language,
        "op4_pii_boosted": pii.op4_pii_boosted,
        "op5_kd_top5": kd_search.op5_kd_top5,
        "op6_media_sniff": media.op6_media_sniff,
        "op7_source_mix": mixing.op7_source_mix,
        "op8_best_fit": packing.op8_best_fit,
        "op9_url_trie": url_filter.op9_url_trie,
        "op10_byte_cnn": quality_cnn.op10_byte_cnn,
    }


def oracle_sql() -> dict:
    return {"op5_kd_top5": kd_search.OP5_SQL, "op9_url_trie": url_filter.OP9_SQL}
