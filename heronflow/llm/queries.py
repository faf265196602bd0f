"""Queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from heronflow.llm import chat_format, license_scan, prefix_trie, quality_rules, vector_codes
from heronflow.llm.chat_format import op2_chat_format
from heronflow.llm.decontaminate import op3_decontaminate
from heronflow.llm.language_id import op10_language_id
from heronflow.llm.license_scan import op6_license_scan
from heronflow.llm.prefix_trie import op12_prefix_trie
from heronflow.llm.quality_classifier import op9_quality_classifier
from heronflow.llm.quality_rules import op5_quality_rules
from heronflow.llm.sentencepiece_codec import op1_sentencepiece
from heronflow.llm.simhash import op8_simhash
from heronflow.llm.suffix_dedup import op4_suffix_dedup
from heronflow.llm.substring_dedup import op7_substring_dedup
from heronflow.llm.token_store import op13_token_store
from heronflow.llm.vector_codes import op11_vector_codes


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_chat_format, op3_decontaminate, op4_suffix_dedup, op5_quality_rules, op6_license_scan, op7_substring_dedup, op8_simhash, op9_quality_classifier, op10_language_id, op11_vector_codes, op12_prefix_trie, op13_token_store)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.SQL, "op5_quality_rules": quality_rules.SQL, "op6_license_scan": license_scan.SQL, "op11_vector_codes": vector_codes.SQL, "op12_prefix_trie": prefix_trie.SQL}
