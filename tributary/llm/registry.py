"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from tributary.llm import chat, collocations, decontaminate, embeddings, jaccard, langid, licenses, packing, pii, quality, spelling, substring, warc

QUERIES: dict = {
    "op1_warc_index_merge": warc.op1_warc_index_merge,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_embedding_near_dedup": embeddings.op4_embedding_near_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_language_id": langid.op6_language_id,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict = {
    "op1_warc_index_merge": warc.ORACLE, "op3_benchmark_decontamination": decontaminate.ORACLE, "op4_embedding_near_dedup": embeddings.ORACLE, "op5_chat_formatting": chat.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE, "op10_substring_dedup": substring.ORACLE, "op11_collocations": collocations.ORACLE, "op12_license_scan": licenses.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
