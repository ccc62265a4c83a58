"""The queries of this folder, as __spark_entry__ adds them."""

from __future__ import annotations

from seqlake.llm import (
    exact_dedup, language_id, line_dedup, mixing, neighbours, ngram_join, phrases, quotations, sentencepiece, sharding, substring_dedup, token_alignment, warc,
)

QUERIES = {
    "op1_learned_partitions": neighbours.op1_learned_partitions,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quotation_linking": quotations.op3_quotation_linking,
    "op4_ring_sharding": sharding.op4_ring_sharding,
    "op5_sentencepiece": sentencepiece.op5_sentencepiece,
    "op6_language_id": language_id.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_warc": warc.op12_warc,
    "op13_collocations": phrases.op13_collocations,
}

ORACLE = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op3_quotation_linking": quotations.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_collocations": phrases.OP13_SQL,
}
