"""Conversation log: append, backfill, union, history, clear, CSV export
(SURVEY S8, S9, S10, S11, U1, P10).

The log is a Parquet dataset appended to by every batch of requests
(``write.mode("append")``: new files only, no read-modify-write, so two
writers never lose each other's rows). Columns::

    timestamp string (ISO), customer_id string, user_request string,
    intent string (JSON), offer string, recommended_merchants string (JSON)

An older log may lack ``recommended_merchants``: its rows read as ``'[]'``, while a
NULL in a log that has the column stays NULL. In memory ``backfill`` looks at the
columns; in a folder, where old and new files lie side by side, the stored schema gives the
column a default for files that do not have it (as ``ALTER TABLE ... ADD COLUMN ... DEFAULT``
does), so each file decides for its own rows, whoever wrote it. ``union_logs`` unions by
column name, missing columns become NULL. CSV export quotes fields that need it and escapes
quotes by doubling, so JSON text with quotes, commas and newlines survives a
round trip (``csvlog.history`` reads it in splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_COLUMNS = (
    "timestamp", "customer_id", "user_request", "intent", "offer", "recommended_merchants",
)
LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LOG_COLUMNS])
EMPTY_LIST = "[]"


def backfill(old: DataFrame) -> DataFrame:
    if "recommended_merchants" in old.columns:
        return old
    return old.withColumn("recommended_merchants", F.lit(EMPTY_LIST))


def union_logs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows then new rows, columns matched by name."""
    return backfill(old).unionByName(new, allowMissingColumns=True)


VECTORIZED = "spark.sql.parquet.enableVectorizedReader"
#: What the id column reads as in files that do not have it.
_DEFAULT = {"CURRENT_DEFAULT": f"'{EMPTY_LIST}'", "EXISTS_DEFAULT": f"'{EMPTY_LIST}'"}
STORED_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType(), metadata=_DEFAULT if c == "recommended_merchants" else None)
        for c in LOG_COLUMNS
    ]
)


def append(rows: DataFrame, path: str) -> None:
    """Add ``rows`` to the log folder: new files, all six columns (missing ones
    NULL, missing ids ``'[]'``)."""
    rows = backfill(rows)
    kept = [
        (F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c)
        for c in LOG_COLUMNS
    ]
    rows.select(*kept).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All logged rows in time order; an empty table when nothing is logged."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], LOG_SCHEMA)
    if spark.conf.get(VECTORIZED) != "true":
        # the row reader gives the default to NULLs of a file that has the column, too
        raise ValueError(f"history needs {VECTORIZED}, which the session has turned off")
    # the schema is given: no file's own columns decide for the others
    rows = spark.read.schema(STORED_SCHEMA).parquet(path)
    return rows.select(*[F.col(c).cast("string").alias(c, metadata={}) for c in LOG_COLUMNS]).orderBy("timestamp")


def clear(spark: SparkSession, path: str) -> None:
    """Both clear actions empty the same log: overwrite with no rows."""
    spark.createDataFrame([], LOG_SCHEMA).write.mode("overwrite").parquet(path)


def export_csv(log: DataFrame, path: str) -> None:
    """One or more CSV files: NULL is an empty field, empty text ``""``, blanks stay."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    log.write.mode("overwrite").options(header=True, escape='"', **blanks).csv(path)
