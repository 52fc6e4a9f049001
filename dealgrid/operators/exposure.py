"""Merchant exposure from the conversation log.

``recommended_merchants`` is JSON text. Decoding follows the log reader's
rules: an array contributes each element (duplicates count each time), a
scalar counts as one id, ``[]`` / JSON ``null`` / undecodable text / NULL
contribute nothing. Ids keep their JSON kind: the number 1 and the text
"1" are different ids, while 1, 1.0 and true are the same number; whole numbers of
any length are compared by their digits. Nested
arrays/objects inside a list and whole-object rows are dropped (the source
raises on them; stated difference).

Counting is ``groupBy(kind, key).count()``: a partial aggregation, so a hot
merchant id costs one pre-aggregated row per map task, not a skewed
partition.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.functions.ids import logged_key, plain_key
from dealgrid.functions.jsonx import with_json_strict
from dealgrid.functions.text import py_float_repr

# --- Fixed values (labels the leaderboard shows for unknown merchants) -----
UNKNOWN_NAME = "Unknown"
NOT_AVAILABLE = "N/A"
# ---------------------------------------------------------------------------


def decoded_ids(log: DataFrame, column: str = "recommended_merchants") -> DataFrame:
    """One row per logged id occurrence: ``merchant_key, key_kind``.

    Staged: parse once, then type-test the parsed value, then explode and key
    each element; every step reads the previous step's column."""
    parsed = with_json_strict(log.select(column), column, "_v")
    v = F.col("_v")
    typed = parsed.select("_v", F.schema_of_variant(v).alias("_kind"))
    kind = F.col("_kind")
    elems = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        .when(v.isNull() | F.is_variant_null(v) | kind.startswith("OBJECT"), F.array())
        .otherwise(F.array(v))
    )
    return (
        typed.select(F.explode(elems).alias("e"))
        .select(logged_key(F.col("e")).alias("id"))
        .filter(F.col("id").isNotNull())
        .select(F.col("id.key").alias("merchant_key"), F.col("id.key_kind").alias("key_kind"))
    )


COUNTS_SCHEMA = "merchant_key string, key_kind string, exposure bigint"


def exposure_counts(log: DataFrame, column: str = "recommended_merchants") -> DataFrame:
    """``merchant_key, key_kind, exposure`` (BIGINT). A log without the id
    column gives no report (an empty table and a warning), as in A3."""
    if column not in log.columns:
        warnings.warn(f"the log has no '{column}' column; no exposure report", stacklevel=2)
        return log.sparkSession.createDataFrame([], COUNTS_SCHEMA)
    return (
        decoded_ids(log, column)
        .groupBy("merchant_key", "key_kind")
        .agg(F.count(F.lit(1)).alias("exposure"))
    )


def merchant_keys(merchants: DataFrame, id_col: str = "merchant_id") -> DataFrame:
    """``merchants`` with ``merchant_key`` and ``key_kind``: those the JSON-lines
    loader gave, or the id rule applied to a plain id column."""
    if "key_kind" in merchants.columns:
        return merchants.withColumn("merchant_key", F.col(id_col).cast("string"))
    key = plain_key(F.col(id_col), merchants.schema[id_col].dataType)
    return merchants.withColumn("_key", key).select(
        "*", F.col("_key.key").alias("merchant_key"), F.col("_key.key_kind").alias("key_kind")
    ).drop("_key")


def leaderboard(counts: DataFrame, merchants: DataFrame) -> DataFrame:
    """Counts joined to merchant details (left), sorted by exposure descending,
    ties by kind and key. ``merchants``: a catalog or merchant table.

    A merchant that is unknown, or whose record lacks a field (``absent``), is
    labelled; a field that is null stays NULL. ``rating`` is shown as written."""
    m = merchant_keys(merchants)
    rating = F.col("rating_shown") if "rating_shown" in m.columns else py_float_repr(F.col("rating"))
    absent = F.col("absent") if "absent" in m.columns else F.array().cast("array<string>")
    m = m.select(
        "key_kind",
        "merchant_key",
        F.struct(
            "name", "primary_category", rating.alias("rating"), "district", absent.alias("absent")
        ).alias("_m"),
    )
    j = counts.join(m, ["key_kind", "merchant_key"], "left")

    def shown(field: str, label: str):
        missing = F.col("_m").isNull() | F.array_contains(F.col("_m.absent"), field)
        return F.when(missing, F.lit(label)).otherwise(F.col(f"_m.{field}")).alias(field)

    return j.select(
        "merchant_key",
        "key_kind",
        shown("name", UNKNOWN_NAME),
        shown("primary_category", NOT_AVAILABLE),
        shown("rating", NOT_AVAILABLE),
        shown("district", NOT_AVAILABLE),
        F.col("exposure").cast("bigint").alias("exposure"),
    ).orderBy(F.desc("exposure"), "key_kind", "merchant_key")
