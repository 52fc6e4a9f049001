"""The plan a large cluster runs: no dictionary fits the broadcast limit, so
every join the library would broadcast is a salted shuffle join, and hot customers
are split off theirs. Results must not change, and no task may get a hot key whole."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from dealgrid.plans.skew import HOT_KEY_CONF
from dealgrid.operators.postings import DIRECT_CONF
from dealgrid.plans.sizing import BROADCAST_LIMIT_CONF
from dealgrid.sources.fixtures import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
QUERIES = (
    "match_all_intents", "match_food_nearby", "offer_items", "offer_listing",
    "request_outcomes", "log_union", "prompt_table", "match_exact_items",
)


def _norm(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.fixture()
def no_broadcast(spark):
    keys = (BROADCAST_LIMIT_CONF, HOT_KEY_CONF, DIRECT_CONF, "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    # posting lists are read block by block
    spark.conf.set(DIRECT_CONF, "0")
    # a key asked by more than 3 requests counts as hot: both halves of the
    # hot-key split run
    spark.conf.set(HOT_KEY_CONF, "3")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", QUERIES)
def test_shuffle_joins_give_the_same_answer(no_broadcast, name):
    spark = no_broadcast
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    cols = sorted(df.columns)
    got = _norm(df.select(*cols).collect())
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = entry.oracle_sql()[name]
    want = _norm(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    assert got == want
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_hot_customer_split_equals_plain_join(spark):
    """90% of the requests belong to one customer: with the customer table
    not broadcastable, the hot customer is split off; rows are unchanged."""
    from pyspark.sql import functions as F

    from dealgrid.operators.requests import request_asks
    from dealgrid.plans import queries
    from dealgrid.sources import fixtures

    fx = fixtures.relations(spark, "/root/testdata/sf0.01")
    req = queries.fixture_requests(fx).withColumn(
        "customer_id",
        F.when(F.col("request_id") % 10 != 0, F.lit(1)).otherwise(F.col("customer_id")),
    )
    plain = sorted(tuple(r) for r in request_asks(req, fx["fx_customers"]).collect())
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", HOT_KEY_CONF)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(HOT_KEY_CONF, "100")
    try:
        out = request_asks(req, fx["fx_customers"])
        split = sorted(tuple(r) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "Union" in plan
    assert split == plain and len(plain) == 1500


def _rows_per_task(df):
    from pyspark.sql import functions as F

    return sorted(
        r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    )


def test_no_task_gets_a_hot_or_null_key_whole(no_broadcast):
    """Most rows share one key or have none: with broadcasts off, the salted join
    deals the key's rows to many tasks and keeps NULL keys out of the shuffle."""
    from pyspark.sql import functions as F

    from dealgrid.plans.skew import SALTS, spread_join

    spark = no_broadcast
    n = 32_000
    key = F.when(F.col("id") % 4 == 0, F.col("id")).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.lit(7))
    big = spark.range(n).select(F.col("id").alias("row"), key.alias("k")).repartition(8)
    small = spark.range(0, n, 5).select(F.col("id").alias("k"), F.lit("x").alias("payload")).union(
        spark.createDataFrame([(7, "seven")], "k long, payload string")
    )
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spread_join(big, small, ["k"], ["row"], "left")
        hot = _rows_per_task(out.filter("k = 7"))
        null = _rows_per_task(out.filter("k is null"))
        got = sorted(tuple(r) for r in out.select("row", "payload").fillna("").collect())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = sorted(tuple(r) for r in big.join(small, "k", "left").select("row", "payload").fillna("").collect())
    assert got == want and len(got) == n
    assert len(hot) >= SALTS // 2 and hot[-1] < n / 2 / 3
    assert len(null) == 8 and null[-1] < 2 * n / 4 / 8


def test_hot_keys_are_at_most_a_fixed_number(spark, monkeypatch):
    from pyspark.sql import functions as F

    from dealgrid.plans import skew

    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 2)
    old = spark.conf.get(HOT_KEY_CONF, None)
    spark.conf.set(HOT_KEY_CONF, "10")
    try:
        big = spark.range(1000).select(F.col("id"), (F.col("id") % 5).alias("k"))
        big = big.unionByName(spark.range(3).select("id", F.lit(None).cast("long").alias("k")))
        other = spark.range(4).select(F.col("id").alias("o"), F.col("id").alias("v"))
        for how in ("inner", "left", "left_anti"):
            got = skew.split_hot_join(big, other, "k", "o", ["id"], how)
            want = big.join(other.withColumnRenamed("o", "k"), "k", how)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset(HOT_KEY_CONF) if old is None else spark.conf.set(HOT_KEY_CONF, old)


def test_category_fields_do_not_multiply_with_budgets(spark):
    """Category scoring runs once per distinct category fields, however many
    budgets, radii and points the keys have."""
    from pyspark.sql import functions as F

    from dealgrid.operators.match import category_fields, compact_id, scored_pairs
    from dealgrid.operators.requests import request_asks
    from dealgrid.plans import queries
    from dealgrid.sources import fixtures

    fx = fixtures.relations(spark, "/root/testdata/sf0.01")
    asks = request_asks(queries.fixture_requests(fx), fx["fx_customers"]).filter("ask is not null")
    n_keys = asks.select("ask").distinct().count()
    cats = asks.select(
        compact_id(category_fields(F.col("ask"))).alias("cat_id"), category_fields(F.col("ask")).alias("fields")
    ).distinct()
    assert cats.count() * 5 < n_keys
    pairs = fx["fx_merchants"].select(F.lit("spa").alias("mc"), F.lit("food").alias("pc")).distinct()
    assert scored_pairs(cats, pairs).count() <= cats.count()


def test_sizes_of_settings(spark):
    """Sizes with a unit, as clusters set them."""
    from dealgrid.plans.sizing import byte_count
    from dealgrid.plans.skew import planner_broadcasts

    written = {"-1": -1, "0": 0, "10485760b": 10 << 20, "256k": 256 << 10, "10MB": 10 << 20, "1g": 1 << 30, "2 kb": 2048}
    assert {text: byte_count(text) for text in written} == written
    with pytest.raises(ValueError, match="not a size"):
        byte_count("many")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "256k")
        assert planner_broadcasts(spark.range(10))
        spark.conf.set(key, "-1")
        assert not planner_broadcasts(spark.range(10))
    finally:
        spark.conf.set(key, old)
