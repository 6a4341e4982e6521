"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .alignment import op11_tokenizer_alignment
from .bpe import op7_bpe
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op3_block_lstm
from .jaccard_join import op8_jaccard_join
from .langid import op1_cross_parsing
from .merkle import OP5_SQL, op5_merkle_audit
from .mixing import op4_pareto_mix
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .progressive_jpeg import op2_progressive_jpeg
from .sharding import op10_label_propagation
from .superminhash import op12_superminhash
from .token_counts import op9_token_counts

QUERIES = {
    "op1_cross_parsing": op1_cross_parsing,
    "op2_progressive_jpeg": op2_progressive_jpeg,
    "op3_block_lstm": op3_block_lstm,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_merkle_audit": op5_merkle_audit,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_label_propagation": op10_label_propagation,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_superminhash": op12_superminhash,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {"op5_merkle_audit": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op13_prefix_trie": OP13_SQL}
