"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .bpe import op3_bpe
from .chats import OP1_SQL, op1_chat_format
from .html import op5_html
from .langid import op7_language_id
from .lines import OP8_SQL, op8_line_dedup
from .minhash import OP2_SQL, op2_minhash
from .mixing import OP9_SQL, op9_mixing
from .substrings import OP6_SQL, op6_substring_dedup
from .topk import OP4_SQL, op4_top_k
from .vectors import OP10_SQL, op10_embedding_dedup

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_minhash": op2_minhash,
    "op3_bpe": op3_bpe,
    "op4_top_k": op4_top_k,
    "op5_html": op5_html,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op2_minhash": OP2_SQL,
    "op4_top_k": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op10_embedding_dedup": OP10_SQL,
}
