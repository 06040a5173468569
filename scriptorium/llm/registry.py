"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, langid, linecrf, mixing, nbsvm, ordinal, packing, simhash, tokenbin, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": langid.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": ordinal.op4_toxicity,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_token_binary": tokenbin.op6_token_binary,
    "op7_simhash_neardup": simhash.op7_simhash_neardup,
    "op8_quality_classifier": nbsvm.op8_quality_classifier,
    "op9_warc_normalise": warc.op9_warc_normalise,
    "op10_line_labelling": linecrf.op10_line_labelling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
}
