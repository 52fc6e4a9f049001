"""Conversation log: append, backfill, union, CSV round trip."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from dealgrid.sources import convlog, csvlog


def test_union_backfills_missing_column(spark):
    old = spark.createDataFrame([("t1", "1", "hi")], "timestamp string, customer_id string, user_request string")
    new = spark.createDataFrame([("t2", "2", "[3, 4]")], "timestamp string, customer_id string, recommended_merchants string")
    rows = convlog.union_logs(old, new).orderBy("timestamp").collect()
    assert [r.recommended_merchants for r in rows] == ["[]", "[3, 4]"]
    assert rows[1].user_request is None


def test_append_history_clear(spark, scratch):
    path = os.path.join(scratch, "log")
    assert convlog.history(spark, path).count() == 0
    rows = spark.createDataFrame(
        [("2024-01-01T00:00:01", "1", "a", "{}", "x", "[1]")], convlog.LOG_SCHEMA
    )
    convlog.append(rows, path)
    convlog.append(rows, path)
    assert convlog.history(spark, path).count() == 2
    convlog.clear(spark, path)
    assert convlog.history(spark, path).count() == 0


def test_history_of_old_and_new_files_in_one_folder(spark, scratch):
    """Rows of files without the id column read '[]', logged ids and logged NULLs stay,
    in whatever order the files are found."""
    for k, first in enumerate(("old", "new")):
        path = os.path.join(scratch, f"mixed{k}")
        old = spark.createDataFrame([("t1", "1")], "timestamp string, customer_id string")
        new = spark.createDataFrame(
            [("t2", "2", "[1]"), ("t3", "3", None)],
            "timestamp string, customer_id string, recommended_merchants string",
        )
        write_old = lambda: old.write.mode("append").parquet(path)  # noqa: B023, E731
        write_new = lambda: convlog.append(new, path)  # noqa: B023, E731
        for write in (write_old, write_new) if first == "old" else (write_new, write_old):
            write()
        convlog.append(old.withColumn("timestamp", F.lit("t4")), path)
        rows = convlog.history(spark, path).collect()
        assert [(r.timestamp, r.recommended_merchants) for r in rows] == [
            ("t1", "[]"), ("t2", "[1]"), ("t3", None), ("t4", "[]")]
        assert rows[0].user_request is None and len(rows[0]) == 6


def test_nulls_of_files_written_by_others_stay(spark, scratch):
    """A file with the id column keeps its NULLs, whoever wrote it."""
    path = os.path.join(scratch, "foreign")
    spark.createDataFrame(
        [("t2", None, "9"), ("t3", "[4]", "9")], "timestamp string, recommended_merchants string, extra string"
    ).write.parquet(path)
    spark.createDataFrame([("t1", "1")], "timestamp string, customer_id string").write.mode("append").parquet(path)
    convlog.append(spark.createDataFrame([("t4", None)], "timestamp string, recommended_merchants string"), path)
    rows = convlog.history(spark, path)
    assert [(r.timestamp, r.recommended_merchants) for r in rows.collect()] == [
        ("t1", "[]"), ("t2", None), ("t3", "[4]"), ("t4", None)]
    assert rows.filter("recommended_merchants = '[]'").count() == 1
    assert rows.filter("recommended_merchants is null").count() == 2
    spark.conf.set(convlog.VECTORIZED, "false")
    try:
        with pytest.raises(ValueError, match="Vectorized"):
            convlog.history(spark, path)
    finally:
        spark.conf.set(convlog.VECTORIZED, "true")


def test_csv_round_trip_keeps_quotes_and_newlines(spark, scratch):
    text = 'He said "hi",\nthen [1, 2]'
    rows = spark.createDataFrame([("t", "1", text, '{"a": "b"}', "ok", '["1", 2]')], convlog.LOG_SCHEMA)
    path = os.path.join(scratch, "csv")
    convlog.export_csv(rows, path)
    back = csvlog.history(spark, path).first()
    assert back.user_request == text and back.intent == '{"a": "b"}'
    assert back.recommended_merchants == '["1", 2]'


def test_cleanup_removes_this_applications_tables(spark):
    from dealgrid.plans.sizing import cleanup, materialize, work_dir

    t = materialize(spark.range(3), "probe")
    assert t.count() == 3
    root = work_dir(spark, "x").split("/dealgrid/")[0]
    assert cleanup(spark) is True
    assert not os.path.exists(f"{root.replace('file:', '')}/dealgrid/{spark.sparkContext.applicationId}")
