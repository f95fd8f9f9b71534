"""Queries of the corpus operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foretide.llm import bpe, exact_dedup, fill_middle, hard_negatives, language_id, line_dedup, lm, minhash, packing, pii, simhash, suffix_array, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_array.op1_suffix_dedup,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_topk": topk.op8_topk,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
    "op11_minhash": minhash.op11_minhash,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_topk": topk.OP8_SQL,
    "op11_minhash": minhash.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
