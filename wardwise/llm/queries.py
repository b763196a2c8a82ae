"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .chat_format import OP9_SQL, op9_query
from .crf_pii import op2_query
from .edit_leaks import op1_query
from .noisy_toxicity import op6_query
from .oracle import OP5_SQL, OP8_SQL, OP10_SQL
from .path_join import op8_query
from .qr_whitening import op11_query
from .relative_lz_dedup import op10_query
from .ring_shards import op4_query
from .score_aware_search import op3_query
from .simhash_dedup import op12_query
from .suffix_dedup import op5_query
from .trie_bpe import op7_query
from .variant_trie import op13_query

QUERIES = {
    "op1_edit_leaks": op1_query,
    "op2_crf_pii": op2_query,
    "op3_score_aware_search": op3_query,
    "op4_ring_shards": op4_query,
    "op5_suffix_dedup": op5_query,
    "op6_noisy_toxicity": op6_query,
    "op7_trie_bpe": op7_query,
    "op8_path_join": op8_query,
    "op9_chat_format": op9_query,
    "op10_relative_lz_dedup": op10_query,
    "op11_qr_whitening": op11_query,
    "op12_simhash_dedup": op12_query,
    "op13_variant_trie": op13_query,
}

SQL: dict[str, str] = {
    "op5_suffix_dedup": OP5_SQL,
    "op8_path_join": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_relative_lz_dedup": OP10_SQL,
}
