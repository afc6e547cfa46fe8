"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.chat import op9_chat_formatting
from tessella.llm.collocations import op13_phrase_collocations
from tessella.llm.decontaminate import op6_benchmark_decontamination
from tessella.llm.htmltext import op10_html_extraction
from tessella.llm.langid import op8_language_id
from tessella.llm.maxent import op7_lm_scoring
from tessella.llm.media import op1_media_columns
from tessella.llm.oracles import ORACLES
from tessella.llm.packing import op4_packing
from tessella.llm.seedextend import op12_substring_dedup
from tessella.llm.sharding import op3_sharding
from tessella.llm.simhash import op5_simhash_dedup
from tessella.llm.suffixdedup import op2_suffix_dedup
from tessella.llm.whitening import op11_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_language_id": op8_language_id,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_html_extraction": op10_html_extraction,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

__all__ = ["ORACLES", "QUERIES"]
