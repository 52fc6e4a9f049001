"""Joins where the side meant as the dictionary is the larger one, and inputs read once."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from dealgrid.operators import geojoin, match, postings, pricecells
from dealgrid.operators.catalog import match_merchants
from dealgrid.operators.requests import request_asks
from dealgrid.operators.textjoin import sets_fully_contained
from dealgrid.plans import queries, skew
from dealgrid.plans.sizing import BROADCAST_LIMIT_CONF
from dealgrid.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def limit(spark):
    keys = (BROADCAST_LIMIT_CONF, "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def to(n):
        spark.conf.set(BROADCAST_LIMIT_CONF, str(n))

    yield to
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sides(spark):
    few = spark.range(50).select((F.col("id") % 10).alias("k"), F.col("id").alias("f"))
    many = spark.range(20_000).select((F.col("id") % 40).alias("k"), F.col("id").alias("m"))
    return few, many


@pytest.mark.parametrize("bytes_", [0, 20_000, 1 << 30])
def test_meet_gives_the_same_rows_either_way(spark, limit, bytes_):
    limit(bytes_)
    few, many = _sides(spark)
    want = sorted((f % 10, f, m) for f in range(50) for m in range(20_000) if f % 10 == m % 40)
    for pair in (skew.meet(few, many, ["k"], ["f"], ["m"]), skew.meet(many, few, ["k"], ["m"], ["f"])):
        assert sorted((r.k, r.f, r.m) for r in pair.select("k", "f", "m").collect()) == want
        # 50 rows are sent or repeated, whichever place they have
        assert ("rightHint=(strategy=broadcast)" in _plan(pair)) == (bytes_ > 0)


def test_a_large_dictionary_is_not_repeated(spark, limit):
    limit(0)
    few, many = _sides(spark)
    joined = skew.spread_join(few, many, ["k"], ["f"], written=True)
    assert "explode" not in _plan(joined).lower()  # 16 copies of the larger side before
    assert joined.count() == 25_000
    assert skew.salts_for(10_000, 1) == skew.SALTS
    assert skew.salts_for(5, 10) == 1 and skew.salts_for(30, 10) == 3


def test_circles_are_not_sent_to_the_driver(spark, limit):
    """Many points and few places: the places are sent (the circles before)."""
    limit(60_000)
    n = F.col("id")
    points = spark.range(3000).select(
        n.alias("c"), (1.2 + n % 100 / 400).alias("plat"), (103.6 + n % 97 / 300).alias("plon"),
        F.lit(3.0).alias("radius_km"),
    )
    places = spark.range(20).select(n.alias("p"), (1.2 + n / 100).alias("lat"), (103.6 + n / 70).alias("lon"))
    near = geojoin.within_radius(points, places, "p")
    hinted = [line for line in _plan(near).splitlines() if "Join" in line]
    assert any("strategy=broadcast" in line for line in hinted)
    cross = points.crossJoin(places).withColumn(
        "km", geojoin.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    )
    assert near.count() == cross.filter("km <= 3.0").count() > 0
    assert near.rdd.getNumPartitions() > 1  # one task before


@pytest.mark.parametrize("n", [1, skew.SALTS])
def test_what_is_measured_too_large_is_not_sent(spark, limit, tmp_path, n):
    """A table of few bytes in its files and many in memory: the planner sees only the files."""
    limit(100_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    rows, k = 20_000, F.col("id") % 500
    spark.range(rows).select(k.alias("k"), F.lit(1.5).alias("f")).coalesce(1).write.parquet(f"{tmp_path}/few")
    spark.range(rows * n * 2).select(k.alias("k"), F.col("id").alias("m")).write.parquet(f"{tmp_path}/many")
    few, many = spark.read.parquet(f"{tmp_path}/few"), spark.read.parquet(f"{tmp_path}/many")
    assert skew.planner_broadcasts(few)
    few_k = [(q, 1) for q in range(0, 500, 50)]
    some = spark.createDataFrame(few_k, "k long, s int")
    for joined in (
        skew.meet(few, many, ["k"], ["f"], ["m"]),
        skew.meet(many, few, ["k"], ["m"], ["f"]),
        skew.spread_join(many, few, ["k"], ["m"], "left", written=True),
    ):
        plan = joined._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        got = joined.join(F.broadcast(some), "k").groupBy("k").count().collect()
        assert sorted(tuple(r) for r in got) == [(q, 40 * 40 * n * 2) for q, _ in few_k]


def test_items_are_derived_once(spark, monkeypatch):
    """Cells, names and the single prices of every round read one written table."""
    fx = fixtures.relations(spark, SF)
    written = []
    real = match.materialize
    monkeypatch.setattr(match, "materialize", lambda df, name: written.append(name) or real(df, name))
    seen = []
    cells = match.pricecells.price_cells
    monkeypatch.setattr(match.pricecells, "price_cells", lambda priced: seen.append(priced) or cells(priced))
    asks = request_asks(queries.fixture_requests(fx), fx["fx_customers"])
    match.rank_keys(asks, match_merchants(fx["fx_merchants"]), items=fx["fx_items"])
    assert "item_prices" in written
    assert "Aggregate" not in _plan(seen[0])  # the item relation groups line items
    match.rank_keys(asks, match_merchants(fx["fx_merchants"]), items=seen[0].withColumnsRenamed(
        {"dp": "price"}).withColumn("discount_percent", F.lit(0.0)), items_written=True)
    assert written.count("item_prices") == 1


def test_rounds_send_the_keys_not_the_rows(spark, limit, monkeypatch):
    """Few keys on a long list: the list is neither repeated nor sent."""
    monkeypatch.setattr(postings, "BLOCK_ROWS", 16)
    limit(40_000)
    n = F.col("id")
    rows = spark.range(4000).select(F.lit("l").alias("list_id"), (n % 7).alias("score"), n.alias("pos"))
    order = [F.col("score").desc(), F.col("pos").asc()]
    blocks = postings.build(rows, order, [F.max("pos").alias("most")])
    keys = spark.createDataFrame([("a", "l", 5), ("b", "l", 3990)], "key string, list_id string, least long")
    sides = []
    real = postings.meet
    monkeypatch.setattr(postings, "meet", lambda *a: sides.append(real(*a)) or sides[-1])
    found = postings.first_k(
        keys, "key", blocks, 3, order, F.col("most") >= F.col("least"),
        lambda read: read.filter("pos >= least").select("key", "score", "pos"),
    ).found.collect()
    assert all("explode" not in _plan(s).lower() for s in sides) and len(sides) > 1
    want = {
        key: sorted(((-(p % 7), p) for p in range(least, 4000)))[:3] for key, least in (("a", 5), ("b", 3990))
    }
    got = {key: [(-r.score, r.pos) for r in sorted(found, key=lambda r: r.place) if r.key == key] for key in want}
    assert got == want


def test_only_rows_of_hit_texts_are_shuffled(spark, limit):
    """Owners with a text that no term hits are filtered before any shuffle by owner."""
    rows = [(o, f"text {o % 7}") for o in range(60)] * 2 + [(None, "text 3"), (3, None), (5, "")]
    texts = spark.createDataFrame(rows, "owner long, text string")
    sets = spark.createDataFrame([(["3", "t 3"],), (["t 2", "t 5"],), (["absent"],)], "terms array<string>")
    want = {(("3", "t 3"), o) for o in range(60) if o % 7 == 3}
    for bytes_ in (1 << 30, 0):
        limit(bytes_)
        found = sets_fully_contained(sets, "terms", texts, "owner", "text")
        assert {(tuple(r.terms), r.owner) for r in found.collect()} - {(("3", "t 3"), None)} == want
        # every (owner, text) was grouped before
        assert bool(re.search(r"Aggregate \[owner#\d+L?, text#", _plan(found))) == (bytes_ == 0)


def test_catalog_of_the_picked_merchants(spark, limit, monkeypatch):
    """Items of merchants that nobody was offered are not grouped; rows stay as in the whole
    catalog, repeated merchants included."""
    merchants = spark.createDataFrame(
        [(m, m, f"m{m}", "c", "p", 4.0, 1.3, 103.8, "d") for m in (1, 2, 2, 3)],
        "merchant_id long, pos long, name string, category string, primary_category string, rating double,"
        "lat double, lon double, district string",
    )
    items = spark.createDataFrame(
        [(m, p, f"i{p}", float(p), None) for m in (1, 2, 3, None) for p in range(5)],
        "merchant_id long, pos long, name string, price double, discount_percent double",
    )
    fx = {"fx_merchants": merchants, "fx_items": items}
    ranked = spark.createDataFrame([("a", 2), ("b", 2), ("b", 9)], "ask_id string, merchant_id long")
    read = []
    real = queries.build_catalog
    monkeypatch.setattr(queries, "build_catalog", lambda m, i: read.append(i.count()) or real(m, i))
    whole = real(merchants, items).select(*queries.SUMMARY_COLUMNS).filter("merchant_id = 2").collect()
    for bytes_, n in ((1 << 30, 5), (0, 20)):
        limit(bytes_)
        out = queries._picked_catalog(fx, ranked, queries.SUMMARY_COLUMNS)  # noqa: SLF001
        assert out.filter("merchant_id = 2").collect() == whole and len(whole) == 2
        assert read[-1] == n


def test_offers_read_the_catalog_of_their_picks(spark, monkeypatch):
    seen = []
    real = queries.build_catalog
    monkeypatch.setattr(queries, "build_catalog", lambda m, i: seen.append(m) or real(m, i))
    offered = {r.merchant_id for r in queries.offer_listing(spark, SF).select("merchant_id").collect()}
    for query in (queries.offer_items, queries.prompt_table):
        seen.clear()
        query(spark, SF)
        # all merchants before
        assert {r.merchant_id for r in seen[0].select("merchant_id").collect()} == offered


def test_only_cells_that_a_budget_leaves_open_are_formed(spark, limit, monkeypatch):
    prices = {m: [100 + (m * 13 + i * 29) % 97 / 10 for i in range(9)] for m in range(30)}
    rows = [(m, p) for m, own in prices.items() for p in own] * 2 + [(None, 100.1), (3, None), (4, float("nan"))]
    items = spark.createDataFrame(rows, "merchant_id long, dp double")
    asked = [(m, a, 100 + a / 4, 100 + a / 4 + 0.3) for m in (*range(0, 30, 3), 99) for a in range(36)]
    unsure = spark.createDataFrame(asked, "merchant_id long, ask int, lo double, hi double")
    want = sorted((m, a) for m, a, lo, hi in asked if any(lo <= p <= hi for p in prices.get(m, [])))
    assert 0 < len(want) < len(asked)
    names = []
    real = pricecells.materialize
    monkeypatch.setattr(pricecells, "materialize", lambda df, name: names.append(name) or real(df, name))
    for bytes_, formed in ((1 << 30, 0), (0, 1)):
        limit(bytes_)
        names.clear()
        found = pricecells.price_cells(items)
        for _ in range(2):
            settled = pricecells.settle(unsure, found).collect()
            assert sorted((r.merchant_id, r.ask) for r in settled) == want
        # every cell of every merchant was formed before
        assert names.count("price_cells") == formed
        open_cells = unsure.filter("merchant_id = 3").select("merchant_id", pricecells.cell_of(F.col("lo")).alias("cell"))
        few = {r.merchant_id for r in found.among(open_cells).collect()}
        assert few == ({3} if not formed else {None, *prices})
