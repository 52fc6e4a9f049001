"""The conversation log as CSV files, read in splits.

A quoted field may hold line ends, so a record may take several lines and a reader that
starts inside a file does not know whether it stands inside quotes. ``multiLine`` reads
each file in one task for that reason. Here the lines of all splits are read in parallel
and quotes are counted:

1. Each line gets, within its split, the parity of the quotes so far and the number of
   record ends so far, under the assumption that the split starts outside quotes. Where it
   starts inside, both simply turn round, so one pass serves either case. One
   shuffle, on (file, split).
2. One row per split (last parity, ends) gives, by running sums over a file's splits, how each
   split starts and how many records end before it. These rows are few: one for every
   ``spark.sql.files.maxPartitionBytes`` of input.
3. A line that starts and ends outside quotes is a record. Only the lines of
   other records are grouped, by (file, record), and joined again.
4. Records are parsed by ``from_csv`` and their fields matched to the log's columns by the
   header of their own file.

Defined cases: an empty field without quotes is NULL, ``""`` is empty text; blank lines between
records are skipped; ``\\r\\n`` ends a record like ``\\n`` and stays as it is inside quotes; a byte
order mark is dropped; columns which a file's header lacks are NULL (ids: ``'[]'``),
other columns are ignored; a short record's missing fields are NULL; missing paths and empty
files give no rows. Quotes stand around whole fields and are doubled
inside (RFC 4180); a file whose quotes do not balance raises, as any reading of it would be a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrid.plans.sizing import materialize
from dealgrid.plans.skew import spread_join
from dealgrid.sources.convlog import EMPTY_LIST, LOG_COLUMNS, LOG_SCHEMA

BYTE_ORDER_MARK = "\ufeff"
#: The null value stands for empty fields without quotes; a text that no field holds keeps ``""``
#: apart from them.
OPTIONS = {
    "nullValue": "\u0001null",
    "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
SHOWN_FILES = 5


def _quotes(text: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit('"'), F.lit("")))


def _numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, row, value, quotes`` and, within the split, ``odd`` (parity after the
    line), ``n`` (lines so far) and ``ends`` (lines so far with an even parity)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    so_far = (
        Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        lines.withColumn("quotes", _quotes("value"))
        .withColumn("odd", (F.sum("quotes").over(so_far) % 2).cast("int"))
        .withColumn("n", F.count(F.lit(1)).over(so_far))
        .withColumn("ends", F.sum(1 - F.col("odd")).over(so_far))
    )


def _split_starts(lines: DataFrame) -> DataFrame:
    """``file, split, start_odd, before``: the parity at which a split starts and the records
    that end before it."""
    splits = lines.groupBy("file", "split").agg(
        F.max("n").alias("n"), F.max("ends").alias("ends"), F.max_by("odd", "n").alias("odd")
    )
    earlier = (
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = splits.withColumn(
        "start_odd", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int")
    )
    closed = F.when(F.col("start_odd") == 0, F.col("ends")).otherwise(F.col("n") - F.col("ends"))
    return starts.withColumn("closed", closed).select(
        "file", "split", "start_odd", "odd",
        F.coalesce(F.sum("closed").over(earlier), F.lit(0)).alias("before"),
    )


def _check_balance(starts: DataFrame) -> None:
    open_files = starts.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1")
    found = [r.file for r in open_files.orderBy("file").limit(SHOWN_FILES).collect()]
    if found:
        raise ValueError(f"quotes do not balance in {found}")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, record, text``: the records of CSV files, numbered from 0 within a file,
    blank ones left out."""
    lines = materialize(_numbered_lines(spark, path), "csv_lines")
    starts = materialize(_split_starts(lines), "csv_splits")
    _check_balance(starts)
    # a file may be one split or all of them
    placed = spread_join(
        lines, starts.drop("odd"), ["file", "split"], ["row"], name="csv_splits", written=True
    )
    ended = (F.col("odd") + F.col("start_odd")) % 2 == 0
    started = (F.col("odd") + F.col("start_odd") + F.col("quotes")) % 2 == 0
    closed = F.when(F.col("start_odd") == 0, F.col("ends")).otherwise(F.col("n") - F.col("ends"))
    placed = placed.select(
        "file", "split", "row", "value",
        (F.col("before") + closed - ended.cast("int")).alias("record"),
        (started & ended).alias("whole"),
    )
    whole = placed.filter("whole").select("file", "record", F.col("value").alias("text"))
    pieces = placed.filter("not whole").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "row", "value"))).alias("lines")
    )
    joined = pieces.select(
        "file", "record", F.array_join(F.transform("lines", lambda p: p["value"]), "\n").alias("text")
    )
    text = F.regexp_replace("text", "\r$", "")
    first = F.col("record") == 0
    text = F.when(first, F.ltrim(text, F.lit(BYTE_ORDER_MARK))).otherwise(text)
    return whole.unionByName(joined).withColumn("text", text).filter("text <> ''")


def _fields(text: str, width: int) -> Column:
    kinds = ", ".join(f"c{i} string" for i in range(width))
    row = F.from_csv(F.col(text), kinds, OPTIONS)
    return F.array(*[row[f"c{i}"] for i in range(width)])


def history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of CSV log files with the log's six columns, in time order."""
    paths = [path] if isinstance(path, str) else list(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
    found = [p for p in paths if jvm_path(p).getFileSystem(conf).globStatus(jvm_path(p))]
    if not found:
        return spark.createDataFrame([], LOG_SCHEMA)
    rows = materialize(records(spark, found), "csv_records")
    headers = rows.filter("record = 0").select("file", F.col("text").alias("header"))
    # commas inside quoted names make this an upper bound
    commas = F.length("header") - F.length(F.replace(F.col("header"), F.lit(","), F.lit("")))
    width = (headers.agg(F.max(commas)).first()[0] or 0) + 1
    headers = headers.select("file", _fields("header", width).alias("names"))
    body = rows.filter("record > 0").select("file", "record", _fields("text", width).alias("values"))
    named = spread_join(body, headers, ["file"], ["record"], name="csv_headers")

    def column(name: str) -> Column:
        at = F.array_position("names", name)
        absent = F.lit(EMPTY_LIST) if name == "recommended_merchants" else F.lit(None).cast("string")
        return F.when(at > 0, F.try_element_at("values", at.cast("int"))).otherwise(absent).alias(name)

    return named.select(*[column(c) for c in LOG_COLUMNS]).orderBy("timestamp")
