"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from stratavox.llm.bpe import op1_bpe
from stratavox.llm.chat import OP8_SQL, op8_chat
from stratavox.llm.classifier import op3_quality_classifier
from stratavox.llm.minhash import op6_minhash
from stratavox.llm.packing import op5_packing
from stratavox.llm.quality_rules import OP2_SQL, op2_quality_rules
from stratavox.llm.sharding import OP10_SQL, op10_sharding
from stratavox.llm.substring import op7_substring_dedup
from stratavox.llm.suffixes import op4_suffix_dedup
from stratavox.llm.vectors import op9_vectors

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat": op8_chat,
    "op9_vectors": op9_vectors,
    "op10_sharding": op10_sharding,
}
ORACLES = {"op2_quality_rules": OP2_SQL, "op8_chat": OP8_SQL, "op10_sharding": OP10_SQL}
