"""Dense global positions without a one-task window."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.plans.positions import with_positions


def test_positions_are_dense_and_follow_the_order(spark):
    """A third of the rows share the first sort value; nulls come last."""
    n = 20_000
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 100 == 1, F.lit(None))
        .otherwise(F.xxhash64("id") % 50).alias("v"),
    )
    rows = with_positions(df, [F.desc("v"), "id"]).collect()
    want = sorted(rows, key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert [r.position for r in want] == list(range(n))


def test_rows_spread_over_partitions_and_no_single_partition_window(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(50_000).select(F.lit(1).alias("v"), "id")
        out = with_positions(df, ["v", "id"])
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert out.agg(F.max("position"), F.countDistinct("position")).first() == (49_999, 50_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    plan = out._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "Window" not in plan and "SinglePartition" not in plan
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 30_000


def test_repeated_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(1,)] * 5, "v int")
    assert sorted(r.position for r in with_positions(same, ["v"]).collect()) == list(range(5))
    assert with_positions(same.limit(0), ["v"]).count() == 0
