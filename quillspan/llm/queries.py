"""The subpackage's queries by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from . import embeddings, erasure, fmindex, langid, lines, minhash, mixing, pii, quality, sharding, substrings, vectorcodes, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_warc": warc.op2_warc,
    "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
    "op4_decontamination": fmindex.op4_decontamination,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": langid.op8_language_id,
    "op9_sharding": sharding.op9_sharding,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_quality": quality.op11_quality,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_erasure": erasure.op13_erasure,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op3_embedding_near_dedup": embeddings.OP3_SQL,
    "op4_decontamination": fmindex.OP4_SQL,
    "op5_minhash_near_dedup": minhash.OP5_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op12_vector_codes": vectorcodes.OP12_SQL,
}
