"""Exposure counts and leaderboard."""

from __future__ import annotations

import pytest

from dealgrid.operators.exposure import exposure_counts, leaderboard

CASES = [
    (["[1,2,2]", "[2,3]", "[]"], {("number", "2"): 3, ("number", "1"): 1, ("number", "3"): 1}),
    (["[1,2]", "bad", None, "null"], {("number", "1"): 1, ("number", "2"): 1}),
    (["5", "[5]", '"abc"'], {("number", "5"): 2, ("text", "abc"): 1}),
    (["[1,1.0,true]", '["1"]'], {("number", "1"): 3, ("text", "1"): 1}),
    (["[1, null, 1]", "[[2], []]", '{"a": 1}'], {("number", "1"): 2}),
]


@pytest.mark.parametrize("idx", range(len(CASES)))
def test_counts(spark, idx):
    cells, expected = CASES[idx]
    log = spark.createDataFrame([(c,) for c in cells], "recommended_merchants string")
    got = {(r.key_kind, r.merchant_key): r.exposure for r in exposure_counts(log).collect()}
    assert got == expected


def test_leaderboard_labels_unknown_and_text_ids(spark):
    log = spark.createDataFrame([("[1, 1, 2]",), ('["1"]',), ("[9]",)], "recommended_merchants string")
    merchants = spark.createDataFrame(
        [(1, "One", "Food", 4.0, "Orchard"), (2, "Two", "Gifts", None, "Bugis")],
        "merchant_id long, name string, primary_category string, rating double, district string",
    )
    rows = leaderboard(exposure_counts(log), merchants).collect()
    assert [(r.merchant_key, r.key_kind, r.name, r.exposure) for r in rows] == [
        ("1", "number", "One", 2),
        ("2", "number", "Two", 1),
        ("9", "number", "Unknown", 1),
        ("1", "text", "Unknown", 1),
    ]
    assert rows[1].rating is None and rows[2].primary_category == "N/A"


def test_missing_column_gives_no_report(spark):
    log = spark.createDataFrame([("t",)], "timestamp string")
    with pytest.warns(UserWarning):
        assert exposure_counts(log).count() == 0


def test_stream_publishes_counts_and_leaderboard(spark):
    from dealgrid.streaming.exposure_stream import run_exposure_stream

    log = spark.createDataFrame(
        [("[1, 2]",), ("[2]",), ("bad",), ('["2"]',), ("[2, 3]",)], "recommended_merchants string"
    )
    merchants = spark.createDataFrame(
        [(2, "Two", "Gifts", 4.0, "Bugis")],
        "merchant_id long, name string, primary_category string, rating double, district string",
    )
    counts, board = run_exposure_stream(spark, log, batches=3, merchants=merchants)
    got = {(r.key_kind, r.merchant_key): r.exposure for r in counts.collect()}
    assert got == {("number", "1"): 1, ("number", "2"): 3, ("number", "3"): 1, ("text", "2"): 1}
    top = board.orderBy("exposure", ascending=False).first()
    assert (top.merchant_key, top.name, top.exposure) == ("2", "Two", 3)


def test_stream_restart_counts_each_file_once(spark):
    """Stop after the first files, append more, start again from the same
    checkpoint: counts cover old and new files, each exactly once."""
    from dealgrid.plans.sizing import work_dir
    from dealgrid.streaming.exposure_stream import published, start_exposure_stream

    base = work_dir(spark, "stream-restart")
    log_path, out_path, ckpt = f"{base}/log", f"{base}/counts", f"{base}/ckpt"
    first = spark.createDataFrame([("[1, 2]",), ("[2]",)], "recommended_merchants string")
    first.coalesce(1).write.mode("append").parquet(log_path)
    start_exposure_stream(spark, log_path, out_path, ckpt).awaitTermination()
    before = published(spark, out_path)
    got = {r.merchant_key: r.exposure for r in before.collect()}
    assert got == {"1": 1, "2": 2}

    more = spark.createDataFrame([("[2, 3]",)], "recommended_merchants string")
    more.coalesce(1).write.mode("append").parquet(log_path)
    start_exposure_stream(spark, log_path, out_path, ckpt).awaitTermination()
    got = {r.merchant_key: r.exposure for r in published(spark, out_path).collect()}
    assert got == {"1": 1, "2": 3, "3": 1}
    # a reader of the earlier batch still has it whole
    assert {r.merchant_key: r.exposure for r in before.collect()} == {"1": 1, "2": 2}


def test_reader_sees_the_last_whole_batch(spark):
    """A batch without its last table's _SUCCESS (being written, or left by a crash) is
    not read."""
    from dealgrid.plans.sizing import work_dir
    from dealgrid.streaming.exposure_stream import published

    out = work_dir(spark, "stream-publish")
    assert published(spark, out) is None
    spark.range(3).write.parquet(f"{out}/batch=0/counts")
    spark.range(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{out}/batch=1/counts"
    )
    assert published(spark, out).count() == 3
