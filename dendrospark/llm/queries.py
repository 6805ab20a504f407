"""The registered queries of this subpackage and their DuckDB SQL."""

from . import (bpe, class_lm, fim, langid, multi_index, packing, quality, sharding, simhash, suffix_dedup, threshold,
               toxicity, trie)

QUERIES = {f.__name__: f for f in (
    simhash.op1_simhash_near_dedup,
    toxicity.op2_toxicity,
    packing.op3_packing,
    langid.op4_language_id,
    class_lm.op5_class_lm,
    multi_index.op6_multi_index_hashing,
    suffix_dedup.op7_suffix_array_dedup,
    sharding.op8_jump_sharding,
    bpe.op9_byte_bpe,
    threshold.op10_threshold_topk,
    fim.op11_fill_in_middle,
    quality.op12_neighbour_quality,
    trie.op13_conversation_trie,
)}

ORACLE = {"op8_jump_sharding": sharding.ORACLE, "op10_threshold_topk": threshold.ORACLE,
          "op11_fill_in_middle": fim.ORACLE, "op13_conversation_trie": trie.ORACLE}
