"""Queries of the training-data operators for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op2_decontaminate
from .fingerprint import op10_fingerprints
from .language import op3_language_id
from .oracle import ORACLE as ORACLE
from .pieces import op9_sentencepiece
from .quotation import op6_quotation_linking
from .sharding import op5_sharding
from .simhash import op7_simhash
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_output import op8_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_language_id, op4_suffix_dedup, op5_sharding, op6_quotation_linking, op7_simhash, op8_token_output, op9_sentencepiece, op10_fingerprints)}

