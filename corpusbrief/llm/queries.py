"""The registered queries of this folder and the DuckDB SQL of those that SQL can express."""
from __future__ import annotations

from . import chat_repair, decontam_automaton, line_dedup, line_rules, url_digest, vector_range, warc_zstd
from .chat_repair import op12_chat_repair
from .decontam_automaton import op1_decontam_automaton
from .langid_bloom import op5_langid_bloom
from .line_dedup import op10_line_dedup
from .line_rules import op11_line_rules
from .packing_mt import op9_packing_mt
from .pii_weak import op4_pii_weak
from .simhash_golay import op6_simhash_golay
from .suffix_levels import op3_suffix_levels
from .token_align import op13_token_align
from .url_digest import op7_url_digest
from .vector_range import op8_vector_range
from .warc_zstd import op2_warc_zstd

QUERIES = {f.__name__: f for f in (
    op1_decontam_automaton, op2_warc_zstd, op3_suffix_levels, op4_pii_weak, op5_langid_bloom, op6_simhash_golay,
    op7_url_digest, op8_vector_range, op9_packing_mt, op10_line_dedup,
    op11_line_rules, op12_chat_repair, op13_token_align)}

SQL = {"op1_decontam_automaton": decontam_automaton.SQL, "op2_warc_zstd": warc_zstd.SQL, "op7_url_digest": url_digest.SQL,
       "op8_vector_range": vector_range.SQL, "op10_line_dedup": line_dedup.SQL,
       "op11_line_rules": line_rules.SQL, "op12_chat_repair": chat_repair.SQL}
