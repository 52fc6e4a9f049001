"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealgrid.llm import (
    bpe,
    filter_audit,
    knn,
    langid,
    license_scan,
    line_dedup,
    lm,
    minhash,
    mixing,
    outliers,
    quality,
    toxicity,
    whitening,
)
from dealgrid.llm.common import table

#: Rank file of the installed public tokenizers; a parameter of ``bpe``.
BPE_FILE = "byte_bpe_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.digests(spark, docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_exact_top_k": knn.op3_exact_top_k,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_language_id": langid.op5_language_id,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm_score": lm.op7_lm_score,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_quality_rules": outliers.op10_quality_rules,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_whitening": whitening.op13_whitening,
}

#: op1, op5, op6, op7, op9, op10, op12 and op13 learn or merge step by step, which SQL cannot
#: express; their tests compare them with brute force, a library or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_exact_top_k": knn.SQL,
    "op4_license_scan": license_scan.SQL,
    "op8_minhash_near_dedup": minhash.SQL,
    "op11_filter_audit": filter_audit.SQL,
}
