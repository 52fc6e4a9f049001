"""JSON-lines ingest with keyed, last-wins semantics (SURVEY S1-S6, S12, F1,
F5, §2.1).

* Each line is parsed on its own (``spark.read.text`` + strict JSON parsing):
  blank and unparsable lines are skipped, a field of an odd type never drops
  its line (unlike ``read.json`` in DROPMALFORMED mode). Lines that are not
  JSON objects are skipped too.
* Input order is ``(file path, block start, row id)``, taken in the scan.
* Keys are normalised like Python's ``int()``: integers, truncated floats,
  booleans and integer text become numbers; other text stays text; a
  missing/null key drops the record. The key is ``(key_kind, key)``.
* Per key the **last** line wins and the position of the **first** line is
  kept: ``groupBy(key).agg(max_by(record, ord), min(ord))``, a partial
  aggregation, so a key repeated millions of times is combined map-side.
* Typed projections distinguish an absent field (default value) from an
  explicit JSON null (NULL, i.e. "this filter does not apply").
* A missing path gives an empty table with the schema (and a warning).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.functions import jsonx as jx
from dealgrid.functions.geo import DEFAULT_MERCHANT_LAT, DEFAULT_MERCHANT_LON
from dealgrid.functions.ids import normalised_key
from dealgrid.functions.jsonx import py_float_variant, strict_number, with_json_strict

# --- Fixed values (defaults for absent merchant fields) --------------------
DEFAULT_RATING = 0.0
# ---------------------------------------------------------------------------



def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``v variant, ord struct`` per parsable JSON-object line, in input order."""
    paths = [path] if isinstance(path, str) else list(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001

    def found(p: str) -> bool:
        # globStatus understands both plain paths and patterns like dir/*.jsonl
        matches = jvm_path(p).getFileSystem(conf).globStatus(jvm_path(p))
        return matches is not None and len(matches) > 0

    existing = [p for p in paths if found(p)]
    schema = T.StructType([
        T.StructField("v", T.VariantType()),
        T.StructField("ord", T.StructType([
            T.StructField("file", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("row", T.LongType()),
        ])),
    ])
    if not existing:
        warnings.warn(f"data file(s) {paths} not found; using an empty table", stacklevel=2)
        return spark.createDataFrame([], schema)
    lines = with_json_strict(spark.read.text(existing), "value", "v")
    parsed = lines.select(
        "v",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ord"),
    )
    return parsed.filter(F.col("v").isNotNull() & jx.kind(F.col("v")).startswith("OBJECT"))


def keyed_last_wins(records: DataFrame, key_field: str) -> DataFrame:
    """``key_kind, key, v, pos``: one record per key, last line wins, ``pos``
    is the position (``ord``) of the key's first line."""
    keyed = records.select(
        normalised_key(F.variant_get("v", f"$.{key_field}", "variant")).alias("k"), "v", "ord"
    ).filter(F.col("k").isNotNull())
    return keyed.groupBy(
        F.col("k.key_kind").alias("key_kind"), F.col("k.key").alias("key")
    ).agg(
        F.max_by(F.col("v"), F.col("ord")).alias("v"),
        F.min("ord").alias("pos"),
    )


def _with_default(v: Column, default: float) -> Column:
    """Absent -> default; present -> ``float(value)`` or NULL."""
    return F.when(v.isNull(), F.lit(default)).otherwise(py_float_variant(v))


def _shown_number(v: Column) -> Column:
    """A number of the offer summary: absent -> 0, not convertible -> NULL."""
    return F.when(v.isNull(), F.lit(0.0)).otherwise(py_float_variant(v))


#: Fields whose absence the leaderboard shows in words, with their paths.
SHOWN_FIELDS = {
    "name": "name",
    "primary_category": "primary_category",
    "rating": "rating",
    "district": "address.district",
}


def _absent(v: Column) -> Column:
    """Names of the ``SHOWN_FIELDS`` the record does not have."""
    flags = [
        F.when(jx.field(v, path).isNull(), F.lit(name)) for name, path in SHOWN_FIELDS.items()
    ]
    return F.array_compact(F.array(*flags))


def merchants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed merchants (keyed, deduplicated) from JSON lines."""
    recs = keyed_last_wins(read_records(spark, path), "merchant_id")
    v = F.col("v")
    items = F.try_variant_get(jx.field(v, "items"), "$", "array<variant>")
    typed_items = F.transform(
        items,
        lambda it: F.struct(
            jx.text_value(jx.field(it, "name")).alias("name"),
            strict_number(jx.field(it, "price")).alias("price"),
            strict_number(jx.field(it, "discount_percent")).alias("discount_percent"),
            _shown_number(jx.field(it, "price")).alias("price_shown"),
            _shown_number(jx.field(it, "discount_percent")).alias("discount_shown"),
        ),
    )
    return recs.select(
        F.col("key").alias("merchant_id"),
        "key_kind",
        # the id as written in the record, for logs (JSON text: 101, "m-7")
        F.to_json(jx.field(v, "merchant_id")).alias("id_json"),
        "pos",
        jx.text_value(jx.field(v, "name")).alias("name"),
        jx.text_value(jx.field(v, "category")).alias("category"),
        jx.text_value(jx.field(v, "primary_category")).alias("primary_category"),
        _with_default(jx.field(v, "rating"), DEFAULT_RATING).alias("rating"),
        _with_default(jx.field(v, "lat"), DEFAULT_MERCHANT_LAT).alias("lat"),
        _with_default(jx.field(v, "lon"), DEFAULT_MERCHANT_LON).alias("lon"),
        jx.text_value(jx.field(v, "address.district")).alias("district"),
        # the rating as written, for display; ``rating`` is what the filter reads
        jx.py_str_variant(jx.field(v, "rating")).alias("rating_shown"),
        _absent(v).alias("absent"),
        typed_items.alias("items"),
    )


def customers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed customers (keyed, deduplicated) from JSON lines."""
    recs = keyed_last_wins(read_records(spark, path), "consumer_id")
    v = F.col("v")
    txns = F.try_variant_get(jx.field(v, "recent_transactions"), "$", "array<variant>")
    return recs.select(
        F.col("key").alias("consumer_id"),
        "key_kind",
        "pos",
        jx.text_value(jx.field(v, "name")).alias("name"),
        jx.text_value(jx.field(v, "occupation")).alias("occupation"),
        F.try_variant_get(jx.field(v, "age"), "$", "bigint").alias("age"),
        jx.text_value(jx.field(v, "sex")).alias("sex"),
        py_float_variant(jx.field(v, "balance")).alias("balance"),
        jx.text_value(jx.field(v, "address.street")).alias("street"),
        jx.text_value(jx.field(v, "address.postal_code")).alias("postal_code"),
        jx.text_value(jx.field(v, "address.district")).alias("district"),
        F.try_variant_get(jx.field(v, "membership_duration_days"), "$", "bigint").alias(
            "membership_duration_days"
        ),
        F.transform(
            txns,
            lambda t: F.struct(
                jx.py_str_variant(jx.field(t, "merchant_id")).alias("merchant_id"),
                (jx.kind(jx.field(t, "merchant_id")) == "STRING").alias("text_id"),
                py_float_variant(jx.field(t, "amount")).alias("amount"),
                jx.py_str_variant(jx.field(t, "amount")).alias("amount_shown"),
                jx.text_value(jx.field(t, "category")).alias("category"),
            ),
        ).alias("transactions"),
    )


def load_dimensions(
    spark: SparkSession, merchants_path: str | list[str], customers_path: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Merchant catalog and customers, loaded once and kept for the session
    (S12). Persisted memory-and-disk: a lost block is recomputed from the
    files, so losing an executor costs time, not the job."""
    from pyspark import StorageLevel

    from dealgrid.operators.catalog import build_catalog, flatten_items

    m = merchants(spark, merchants_path)
    catalog = build_catalog(m, flatten_items(m)).persist(StorageLevel.MEMORY_AND_DISK)
    cust = customers(spark, customers_path).persist(StorageLevel.MEMORY_AND_DISK)
    return catalog, cust
