"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.best_fit import op11_best_fit
from tessella.llm.decontam import op4_decontamination
from tessella.llm.gru_lm import op6_lm_score
from tessella.llm.line_dedup import OP5_SQL, op5_line_dedup
from tessella.llm.packing import op7_packing
from tessella.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from tessella.llm.quality_cnn import op3_quality
from tessella.llm.quality_rules import OP8_SQL, op8_quality_rules
from tessella.llm.simhash import op2_simhash
from tessella.llm.spelling import OP12_SQL, op12_spelling
from tessella.llm.token_counts import op10_token_counts
from tessella.llm.toxicity import op1_toxicity
from tessella.llm.warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_best_fit": op11_best_fit,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op12_spelling": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
