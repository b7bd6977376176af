"""Queries of the training-data operators, by name, and their SQL where it can express them."""

from __future__ import annotations

from canvass.llm.chat_format import OP5_SQL, op5_chat_format
from canvass.llm.collocations import OP11_SQL, op11_collocations
from canvass.llm.license_scan import op6_license_scan
from canvass.llm.mixing import op4_mixing
from canvass.llm.near_dup import op2_near_dup
from canvass.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from canvass.llm.quality_rules import op9_quality_rules
from canvass.llm.substring_dedup import op8_substring_dedup
from canvass.llm.suffix_dedup import op13_suffix_dedup
from canvass.llm.token_binary import op7_token_binary
from canvass.llm.url_filter import OP3_SQL, op3_url_filter
from canvass.llm.vector_packing import op10_vector_packing
from canvass.llm.winnowing import op1_winnowing

QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_near_dup": op2_near_dup,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_license_scan": op6_license_scan,
    "op7_token_binary": op7_token_binary,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_vector_packing": op10_vector_packing,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op11_collocations": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
