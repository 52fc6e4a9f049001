"""From documents to token streams: five stages, each written as Parquet and read
again by the next.

1. language ID: documents without a letter, or without a language that holds at
   least ``LEAST_SHARE`` of their n-grams, go;
2. line dedup: runs of lines of 50 words or more that occur earlier are deleted from
   the texts (``n_chars`` follows); documents of which nothing is left go;
3. MinHash near-dedup (five-word shingles, similarity 0.8): of each group of linked
   documents the one of the smallest doc_id stays, of repeated rows one;
4. mixing: documents whose fitted rate gives no copy go. Rates above one do not
   repeat a document: the corpus has just been freed of copies;
5. byte-level BPE: the texts' tokens, and digests of the tokens and of their decoding.

Stages 1 to 4 return the columns of their input. Rows with a null doc_id are kept by the
stages that decide by id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm import bpe, langid, line_dedup, minhash, mixing
from dealgrid.llm.common import BLANKS, table
from dealgrid.llm.queries import BPE_FILE
from dealgrid.plans.sizing import materialize, measured_broadcast

#: A text in one or two languages always stays (one of them holds at least half); balanced
#: mixtures of three and more go.
LEAST_SHARE = 0.4
SHINGLE_WORDS, PERCENT = 5, 80


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``."""
    return docs.join(measured_broadcast(ids.select("doc_id").distinct(), name), "doc_id", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.filter(~langid.held_out()))
    found = docs.withColumn("_language", langid.language(spark, model)(F.col("text")))
    known = F.col("_language.lang_pred") != langid.UNKNOWN
    return found.filter(known & (F.col("_language.score") >= LEAST_SHARE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(docs)
    blank = F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) == ""
    changed = F.col("_gone") > 0
    return out.filter(~(changed & blank)).select(
        *[
            F.when(changed, F.length("text")).otherwise(F.col(c)).cast("long").alias(c)
            if c == "n_chars"
            else F.col(c)
            for c in docs.columns
        ]
    )


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = materialize(minhash.link(docs, SHINGLE_WORDS, PERCENT), "linked")
    kept = _without(docs, linked.filter("not kept"), "removed")
    again = linked.filter("kept and doc_id is not null").groupBy("doc_id").count()
    again = materialize(again.filter("count > 1").select("doc_id"), "repeated_ids")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, again, "repeated").unionByName(repeated).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(docs, table(spark, sf_dir, "labels"))
    return _without(docs, mixed.filter("copies = 0"), "left_out").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(BPE_FILE)
    both = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, with_decoded=True)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "tokens",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Stages 1 and 4 learn models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
