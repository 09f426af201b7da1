"""The operators' queries and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from . import chats, classifier, exact, licenses, lm, mixing, packing, phrases, quality, repair, repeats, simhash, urls

QUERIES = {f.__name__: f for f in (
    mixing.op1_mixing, urls.op2_url_filters, repeats.op3_suffix_array_dedup, packing.op4_best_fit_packing,
    licenses.op5_license_scans, exact.op6_exact_dedup, simhash.op7_simhash_near_dedup, lm.op8_lm_scoring,
    quality.op9_quality_rules, classifier.op10_quality_classifier,
    repair.op11_conversation_structure_repair, chats.op12_chat_formatting, phrases.op13_phrase_collocations)}
ORACLE = {"op1_mixing": mixing.OP1_SQL, "op2_url_filters": urls.OP2_SQL, "op6_exact_dedup": exact.OP6_SQL,
          "op9_quality_rules": quality.OP9_SQL, "op12_chat_formatting": chats.OP12_SQL, "op13_phrase_collocations": phrases.OP13_SQL}
