"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe_table import op8_bpe_encode_decode
from .chunk_dedup import op5_chunk_dedup
from .kd_shards import op6_kd_shards
from .minhash_dedup import OP4_SQL, op4_minhash_dedup
from .packing import op7_packing
from .simhash import op3_simhash
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op10_token_counts
from .topk_search import OP9_SQL, op9_topk_search
from .toxicity import op2_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_kd_shards": op6_kd_shards,
    "op7_packing": op7_packing,
    "op8_bpe_encode_decode": op8_bpe_encode_decode,
    "op9_topk_search": op9_topk_search,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {"op4_minhash_dedup": OP4_SQL, "op9_topk_search": OP9_SQL}
