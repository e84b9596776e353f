"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, language_id, near_duplicates, piece_codec, quality_classifier, quality_rules, sharding, token_counts, url_filter, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_warc": warc.op2_warc,
    "op4_url_filter": url_filter.op4_url_filter,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op5_near_duplicates": near_duplicates.op5_near_duplicates,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_sentencepiece": piece_codec.op7_sentencepiece,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_language_id": language_id.op10_language_id,
    "sharding_written": sharding.sharding_written,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op5_near_duplicates": near_duplicates.OP5_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "sharding_written": sharding.WRITTEN_SQL,
}
