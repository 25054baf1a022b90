"""Queries of the training-data operators and their SQL, merged by ``__spark_entry__``."""

from __future__ import annotations

from spindrift.llm.op3_simhash import op3_simhash_near_dedup
from spindrift.llm.op5_quality import ORACLE_SQL as OP5_SQL
from spindrift.llm.op5_quality import op5_quality_rules
from spindrift.llm.op8_bpe import op8_byte_bpe
from spindrift.llm.op10_pii import op10_pii
from spindrift.llm.op2_mixing import op2_mixing
from spindrift.llm.op1_html import op1_html_extraction
from spindrift.llm.op4_substring import op4_substring_dedup
from spindrift.llm.op7_sharding import op7_sharding
from spindrift.llm.op7_sharding import oracle_sql as op7_sql
from spindrift.llm.op9_chat import op9_chat_format
from spindrift.llm.op6_ann import op6_nearest_neighbours

QUERIES = {
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op9_chat_format": op9_chat_format,
    "op7_sharding": op7_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op1_html_extraction": op1_html_extraction,
    "op2_mixing": op2_mixing,
    "op10_pii": op10_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op7_sharding": op7_sql(),
    "op5_quality_rules": OP5_SQL,
}
