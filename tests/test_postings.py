"""Early-ending top-k and price cells against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from dealgrid.operators import postings, pricecells


def _lists(draw, n_lists, n_rows):
    return [(f"l{draw.randrange(n_lists)}", draw.randrange(5), i, draw.random()) for i in range(n_rows)]


def _order():
    return [F.col("score").desc(), F.col("pos").asc()]


def _first(spark, rows, keys, k):
    table = spark.createDataFrame(rows, "list_id string, score long, pos long, v double").repartition(7)
    wanted = spark.createDataFrame(keys, "key string, list_id string, least double")
    blocks = postings.build(table, _order(), [F.max("v").alias("most")])
    return postings.first_k(
        wanted, "key", blocks, k, _order(), F.col("most") >= F.col("least"),
        lambda read: read.filter("v >= least").select("key", "score", "pos", "v"),
    ), blocks


@pytest.mark.parametrize("n_lists", [1, 6])
def test_first_k_equals_brute_force(spark, monkeypatch, n_lists):
    monkeypatch.setattr(postings, "BLOCK_ROWS", 8)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(postings, "GROWTH", 3)
    draw = random.Random(n_lists)
    rows = _lists(draw, n_lists, 900)
    keys = [(f"k{i}", f"l{draw.randrange(n_lists + 1)}", draw.choice([0.0, 0.5, 0.97, 2.0])) for i in range(60)]
    first, blocks = _first(spark, rows, keys, 4)
    got = sorted((r.key, r.place, r.pos) for r in first.found.collect())
    want = []
    for key, own, least in keys:
        fit = sorted((-s, p) for name, s, p, v in rows if name == own and v >= least)[:4]
        want += [(key, i, p) for i, (_, p) in enumerate(fit, 1)]
    assert got == sorted(want)
    ranks = sorted((r.list_id, r["rank"]) for r in blocks.summaries.collect())
    for name in {x for x, _ in ranks}:  # ranks are dense, and rise in list order
        assert [n for x, n in ranks if x == name] == list(range(sum(x == name for x, _ in ranks)))
    joined = blocks.rows.join(blocks.summaries.select("list_id", "block", "rank"), ["list_id", "block"]).collect()
    for name in {r.list_id for r in joined}:
        own = sorted((r.rank, -r.score, r.pos) for r in joined if r.list_id == name)
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_reads_follow_keys_not_lists(spark, monkeypatch):
    """Lists of 200 blocks: keys whose filter half of the rows pass read a few each, and a key
    that no row satisfies reads none, by the summaries."""
    monkeypatch.setattr(postings, "BLOCK_ROWS", 16)
    draw = random.Random(4)
    rows = _lists(draw, 2, 6400)
    keys = [(f"k{i}", f"l{i % 2}", 0.5) for i in range(50)] + [("none", "l0", 1.5)]
    first, blocks = _first(spark, rows, keys, 5)
    reads = [r for read in first.reads for r in read.collect()]
    assert blocks.summaries.count() >= 400
    assert len(reads) <= 50 * postings.FIRST_BLOCKS and not any(r.key == "none" for r in reads)
    assert first.found.count() == 250


def test_one_list_spreads_over_tasks(spark):
    n = 40_000
    table = spark.range(n).select(F.lit("hot").alias("list_id"), (F.col("id") % 3).alias("score"), F.col("id").alias("pos"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = postings.build(table, _order(), [F.count(F.lit(1)).alias("n")])
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    parts = blocks.rows.groupBy(F.shiftright("block", 25).alias("part")).count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < n / 6
    assert blocks.summaries.agg(F.max("rank")).first()[0] + 1 == blocks.summaries.count()
    assert blocks.summaries.filter("n > 256").isEmpty()


def test_empty_lists_and_direct_reading(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0.5)], "list_id string, score long, pos long, v double")
    keys = spark.createDataFrame([("k", "a", 0.1), ("m", "b", 0.1)], "key string, list_id string, least double")
    passes = lambda read: read.filter("v >= least").select("key", "score", "pos")
    args = (2, _order(), [F.max("v").alias("most")], F.col("most") >= F.col("least"), passes, "pos")
    for limit in ("0", "100"):
        spark.conf.set(postings.DIRECT_CONF, limit)
        try:
            got = postings.top_k(keys, "key", rows, *args).found.collect()
            none = postings.top_k(keys, "key", rows.limit(0), *args).found.collect()
            nobody = postings.top_k(keys.limit(0), "key", rows, *args).found.collect()
        finally:
            spark.conf.unset(postings.DIRECT_CONF)
        assert [(r.key, r.place, r.pos) for r in got] == [("k", 1, 1)] and none == nobody == []


def test_budgets_by_cells_equal_price_lists(spark):
    draw = random.Random(8)
    prices = {}
    for m in range(60):
        size = draw.choice([1, 1, 3, 40, 300])
        base = draw.choice([0.0, 3.0, 250.0, 90_000.0])
        prices[m] = [round(base + draw.random() * draw.choice([0.02, 1, 60]), draw.choice([2, 6])) for _ in range(size)]
    prices[60] = [0.0, 10.001, 10.009]
    inf, nan = math.inf, math.nan
    budgets = [(0, inf), (nan, 5), (3, nan), (5, 2), (-3, -1), (10.002, 10.008), (10.002, 10.009), (1e9, inf), (-1, 0)]
    for _ in range(150):
        lo = draw.choice([0, 3, 3.5, 250, 90_000]) + round(draw.random(), 2)
        budgets.append((lo, lo + draw.choice([0, 0.005, 0.3, 20, 900])))
    items = spark.createDataFrame(
        [(m, p) for m, ps in prices.items() for p in ps] + [(0, None), (61, None), (62, nan)], "merchant_id long, dp double"
    )
    found = pricecells.price_cells(items)
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(budgets)], "ask int, lo double, hi double")
    inside, edges = pricecells.budget_masks(F.col("lo"), F.col("hi"))
    rows = found.merchants.crossJoin(asked.withColumns({"inside": inside, "edges": edges})).withColumn(
        "fits", pricecells.verdict(F.col("lo"), F.col("hi"), F.col("inside"), F.col("edges"))
    ).cache()
    unsure = rows.filter("fits is null").select("merchant_id", "ask", "lo", "hi")
    assert 0 < unsure.count() < rows.count() / 4
    got = {(r.merchant_id, r.ask) for r in rows.filter("fits").collect()}
    settled = pricecells.settle(unsure, found).collect()
    assert len({(r.merchant_id, r.ask) for r in settled}) == len(settled)
    got |= {(r.merchant_id, r.ask) for r in settled}
    want = {
        (m, i) for m, ps in prices.items() for i, (lo, hi) in enumerate(budgets) if any(lo <= p <= hi for p in ps)
    }
    assert got == want and found.merchants.count() == 61


def test_a_merchant_of_many_items_is_combined_before_the_shuffle(spark):
    items = spark.range(200_000).select(F.lit(1).alias("merchant_id"), (F.rand(3) * 900).alias("dp"))
    found = pricecells.price_cells(items)
    assert found.cells.count() <= pricecells.CELLS and found.merchants.count() == 1
    plan = items.groupBy("merchant_id").count()._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "partial_count" in plan


@pytest.mark.parametrize("limit", ["0", "3000", "9000"])
@pytest.mark.parametrize("n_lists", [1, 6])
def test_only_what_heads_leave_open_is_sorted(spark, monkeypatch, n_lists, limit):
    """Heads that all keys but some find enough in: rows of other lists are not sorted, and every
    key has its rows, whether heads and what is behind them are read whole or in blocks."""
    monkeypatch.setattr(postings, "BLOCK_ROWS", 8)
    monkeypatch.setattr(postings, "HEAD_ROWS", 64)
    monkeypatch.setattr(postings, "BOUND_SAMPLE", 4)
    built = []
    build = postings.build
    monkeypatch.setattr(postings, "build", lambda rows, *args: built.append(rows.count()) or build(rows, *args))
    draw = random.Random(n_lists)
    rows = _lists(draw, n_lists, 2400) + [("short", 1, 5000 + i, 0.6) for i in range(3)]
    least = [0.0, 0.5] * 20 + [0.97, 2.0]
    keys = [(f"k{i}", "l0" if v > 0.6 else f"l{draw.randrange(n_lists)}", v) for i, v in enumerate(least)]
    keys += [("few", "short", 0.5), ("nowhere", "no list", 0.0)]
    table = spark.createDataFrame(rows, "list_id string, score long, pos long, v double").repartition(7)
    wanted = spark.createDataFrame(keys, "key string, list_id string, least double")
    spark.conf.set(postings.DIRECT_CONF, limit)
    try:
        found = postings.top_k(
            wanted, "key", table, 4, _order(), [F.max("v").alias("most")], F.col("most") >= F.col("least"),
            lambda read: read.filter("v >= least").select("key", "score", "pos", "v"), "pos",
            {"score": False, "pos": True},
        ).found
    finally:
        spark.conf.unset(postings.DIRECT_CONF)
    want = []
    for key, own, low in keys:
        fit = sorted((-s, p) for name, s, p, v in rows if name == own and v >= low)[:4]
        want += [(key, i, p) for i, (_, p) in enumerate(fit, 1)]
    assert sorted((r.key, r.place, r.pos) for r in found.collect()) == sorted(want)
    behind = sum(name == "l0" for name, *_ in rows)
    # of the lists, only what is behind the head of the one with a selective key (heads: in blocks at 0)
    assert sum(built) <= (behind + 6 * 2 * 64 if limit == "0" else behind)
    assert n_lists == 1 or max(built, default=0) < len(rows) / 3


def test_a_bound_cuts_a_prefix_of_the_order(spark):
    """NaN and NULL scores, NULL positions: the rows not after a row are those sorted up to it."""
    rows = [(s, p) for s in (None, 1.0, 2.5, math.nan) for p in (None, 1, 2)]
    table = spark.createDataFrame(rows, "score double, pos long")
    cut = postings.not_after({"score": False, "pos": True})
    for at, (score, pos) in enumerate(table.orderBy(*_order()).collect()):
        bound = {"_at_score": F.lit(score).cast("double"), "_at_pos": F.lit(pos).cast("long")}
        got = table.withColumns(bound).select(cut.alias("c")).collect()
        assert sum(r.c for r in got) == at + 1 and all(r.c is not None for r in got)
