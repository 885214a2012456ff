"""The registered queries of this subpackage: name -> (function, oracle SQL)."""

from __future__ import annotations

from . import chat_format, context_mixing, decontaminate, jaccard_join, kd_search, merkle, packing, pii, quality, sentencepieces, structure_repair, token_counts, warc_convert

QUERIES = {
    "op1_token_counts": (token_counts.op1_token_counts, token_counts.SQL),
    "op2_chat_format": (chat_format.op2_chat_format, chat_format.SQL),
    "op3_jaccard_join": (jaccard_join.op3_jaccard_join, jaccard_join.SQL),
    "op4_context_mixing": (context_mixing.op4_context_mixing, context_mixing.SQL),
    "op5_kd_search": (kd_search.op5_kd_search, kd_search.SQL),
    "op6_best_fit_packing": (packing.op6_best_fit_packing, packing.SQL),
    "op7_decontaminate": (decontaminate.op7_decontaminate, decontaminate.SQL),
    "op8_pii": (pii.op8_pii, pii.SQL),
    "op9_warc_convert": (warc_convert.op9_warc_convert, warc_convert.SQL),
    "op10_quality": (quality.op10_quality, quality.SQL),
    "op11_sentencepiece": (sentencepieces.op11_sentencepiece, sentencepieces.SQL),
    "op12_structure_repair": (structure_repair.op12_structure_repair, structure_repair.SQL),
    "op13_merkle_manifest": (merkle.op13_merkle_manifest, merkle.SQL),
}
