"""NaN semantics of the filters and the bonus (Python comparisons with NaN
are false; Spark orders NaN above every number, so the matcher guards)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dealgrid.operators.catalog import build_catalog
from dealgrid.operators.intent import ask_key
from dealgrid.operators.match import top_merchants

NAN = float("nan")
ORCHARD = (1.3048, 103.8318)


def _run(spark, merchants, items, intent):
    m = spark.createDataFrame(
        merchants,
        "merchant_id long, pos long, name string, category string, primary_category string, "
        "rating double, lat double, lon double, district string",
    )
    it = spark.createDataFrame(
        items, "merchant_id long, pos long, name string, price double, discount_percent double"
    )
    prox, minr, lo, hi = intent
    asks = spark.createDataFrame([(1,)], "request_id long").select(
        "request_id",
        F.lit("food").alias("category"),
        F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")).alias("budget"),
        F.lit(prox).cast("double").alias("proximity_km"),
        F.lit(minr).cast("double").alias("min_rating"),
        F.lit(None).cast("array<string>").alias("exact_items"),
        F.lit(None).cast("struct<recipient:string,cuisine:string,atmosphere:string,"
                         "participants:string,solo:boolean,type:string>").alias("specifics"),
        F.lit(False).alias("is_generic"), F.lit(False).alias("is_ambiguous"),
        F.lit("high").alias("confidence"), F.lit(None).cast("array<string>").alias("preferences"),
    ).select("request_id", ask_key(F.struct(F.lit(ORCHARD[0]).alias("lat"),
                                            F.lit(ORCHARD[1]).alias("lon"))).alias("ask"))
    rows = top_merchants(asks, build_catalog(m, it)).orderBy("rank").collect()
    return [(r.merchant_id, r.score) for r in rows]


def _m(mid, rating=4.0, lat=ORCHARD[0], lon=ORCHARD[1]):
    return (mid, mid, f"m{mid}", "x", "Food", rating, lat, lon, "d")


def test_nan_location_keeps_merchant_without_bonus(spark):
    got = _run(spark, [_m(1, lat=NAN), _m(2)], [(1, 0, "a", 10.0, 0.0), (2, 0, "b", 10.0, 0.0)],
               (5.0, None, 0.0, math.inf))
    assert got == [(2, 7.0), (1, 2.0)]


def test_nan_rating_passes_rating_filter(spark):
    got = _run(spark, [_m(1, rating=NAN), _m(2, rating=3.0)],
               [(1, 0, "a", 10.0, 0.0), (2, 0, "b", 10.0, 0.0)], (None, 4.0, 0.0, math.inf))
    assert got == [(1, 2.0)]


def test_nan_rating_floor_is_no_filter(spark):
    got = _run(spark, [_m(1, rating=1.0)], [(1, 0, "a", 10.0, 0.0)], (None, NAN, 0.0, math.inf))
    assert got == [(1, 2.0)]


def test_nan_proximity_filters_nothing_but_keeps_bonus(spark):
    far = _m(2, lat=1.40, lon=103.80)
    got = _run(spark, [_m(1), far], [(1, 0, "a", 10.0, 0.0), (2, 0, "b", 10.0, 0.0)],
               (NAN, None, 0.0, math.inf))
    assert [m for m, _ in got] == [1, 2] and got[0][1] == 7.0 and 2.0 < got[1][1] < 3.0


def test_nan_budget_bound_matches_nothing(spark):
    got = _run(spark, [_m(1)], [(1, 0, "a", 10.0, 0.0)], (None, None, 0.0, NAN))
    assert got == []


def test_nan_price_is_never_in_budget(spark):
    got = _run(spark, [_m(1), _m(2)], [(1, 0, "a", NAN, 0.0), (2, 0, "b", 5.0, NAN)],
               (None, None, 0.0, math.inf))
    assert got == []
