"""The corpus operators' queries, their SQL where SQL can express them, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op5_chat_windows
from .mixing import op2_source_mixing
from .packing import op1_best_fit_packing
from .pii import op4_personal_data
from .quality import op9_quality_rules
from .simhash import op10_simhash_groups
from .suffix_dedup import op3_suffix_dedup
from .token_files import op7_token_files
from .topk import OP6_SQL, op6_bit_sliced_topk
from .url_filter import op8_url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_chat_windows": op5_chat_windows,
    "op6_bit_sliced_topk": op6_bit_sliced_topk,
    "op7_token_files": op7_token_files,
    "op8_url_reputation": op8_url_reputation,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_groups": op10_simhash_groups,
}
SQL: dict[str, str] = {"op6_bit_sliced_topk": OP6_SQL}
