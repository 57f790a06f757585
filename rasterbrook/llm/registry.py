"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from rasterbrook.llm import alignment, bpe, collocations, decontam, langid, lm, media, pii, sharding, simhash, token_counts, token_files, urlfilter

QUERIES = {
    "op1_pii_surrogates": pii.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_lm_scoring": lm.query,
    "op4_byte_level_bpe": bpe.query,
    "op5_benchmark_decontamination": decontam.query,
    "op6_language_id": langid.query,
    "op7_url_filters": urlfilter.query,
    "op8_sharding": sharding.query,
    "op9_media_columns": media.query,
    "op10_token_counts": token_counts.query,
    "op11_token_files": token_files.query,
    "op12_phrase_collocations": collocations.query,
    "op13_tokenizer_alignment": alignment.query,
}

ORACLES = {
    "op4_byte_level_bpe": bpe.ORACLE_SQL,
    "op5_benchmark_decontamination": decontam.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op12_phrase_collocations": collocations.ORACLE_SQL,
}
