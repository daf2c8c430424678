"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from buildlens.llm.binary import op6_simple8b
from buildlens.llm.bpe import op10_byte_bpe
from buildlens.llm.chat import OP4_SQL, op4_prefix_tree
from buildlens.llm.codes import OP12_SQL, op12_norm_of_sum_codes
from buildlens.llm.language import op2_compression_language
from buildlens.llm.packing import op8_certified_packing
from buildlens.llm.quality import OP7_SQL, op7_line_first_cleaning
from buildlens.llm.simhash import op9_gray_simhash
from buildlens.llm.substring import op5_suffix_automata
from buildlens.llm.suffixarray import op11_prefix_intervals
from buildlens.llm.threshold import OP13_SQL, op13_threshold_negatives
from buildlens.llm.toxicity import op1_sentence_toxicity
from buildlens.llm.vafile import OP3_SQL, op3_va_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentence_toxicity, op2_compression_language, op3_va_file, op4_prefix_tree, op5_suffix_automata,
        op6_simple8b, op7_line_first_cleaning, op8_certified_packing, op9_gray_simhash, op10_byte_bpe,
        op11_prefix_intervals, op12_norm_of_sum_codes, op13_threshold_negatives)
}
ORACLE_SQL: dict[str, str] = {
    "op3_va_file": OP3_SQL, "op4_prefix_tree": OP4_SQL, "op7_line_first_cleaning": OP7_SQL,
    "op12_norm_of_sum_codes": OP12_SQL, "op13_threshold_negatives": OP13_SQL,
}
