"""The registered queries of the training-data operators, one `opN_<name>` each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op5_decontamination
from .language import op3_language_id
from .lines import op6_line_dedup
from .merkle import ORACLE as MERKLE_ORACLE
from .merkle import op11_merkle_manifest
from .minhash import op7_minhash_near_dedup
from .neighbours import op2_nearest_neighbours
from .packing import op4_mixture_packing
from .quality import op8_quality_bayes
from .resampling import ORACLE as RESAMPLING_ORACLE
from .resampling import op13_importance_resampling
from .sharding import op10_external_shuffle
from .substrings import op9_substring_dedup
from .token_store import op12_token_index
from .warc import ORACLE as WARC_ORACLE
from .warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_language_id": op3_language_id,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_bayes": op8_quality_bayes,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_external_shuffle": op10_external_shuffle,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_index": op12_token_index,
    "op13_importance_resampling": op13_importance_resampling,
}
#: DuckDB SQL where it can express a query; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_warc": WARC_ORACLE, "op11_merkle_manifest": MERKLE_ORACLE, "op13_importance_resampling": RESAMPLING_ORACLE}
