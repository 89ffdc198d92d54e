"""The ten queries and their SQL."""

from __future__ import annotations

from weftline.llm.bpe import op7_bpe
from weftline.llm.hnsw import OP5_SQL, op5_nearest
from weftline.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from weftline.llm.main_text import OP1_SQL, op1_main_text
from weftline.llm.packing import op8_packing
from weftline.llm.quality_model import op10_quality_model
from weftline.llm.quality_rules import OP2_SQL, op2_quality_rules
from weftline.llm.shuffle_shards import OP4_SQL, op4_shuffle_shards
from weftline.llm.toxicity import op3_toxicity
from weftline.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_shuffle_shards": op4_shuffle_shards,
    "op5_nearest": op5_nearest,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_quality_model": op10_quality_model,
}
SQL = {"op1_main_text": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_shuffle_shards": OP4_SQL, "op5_nearest": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op9_warc": OP9_SQL}
