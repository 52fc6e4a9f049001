"""Distance and gazetteer."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dealgrid.functions.geo import GAZETTEER, district_point, haversine_km


def _dist(spark, a, b):
    df = spark.createDataFrame([(*a, *b)], "a double, b double, c double, d double")
    return df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]


def test_golden_value(spark):
    d = _dist(spark, (1.3048, 103.8318), (1.3592, 103.989))
    assert abs(d - 18.49243667679862) < 1e-9


def test_zero_distance(spark):
    assert _dist(spark, (1.3, 103.8), (1.3, 103.8)) == 0.0


def test_antipodes_guarded(spark):
    d = _dist(spark, (0.0, 0.0), (0.0, 180.0))
    assert abs(d - math.pi * 6371.0) < 1e-6


def test_null_coordinate_gives_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert df.select(haversine_km(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_district_lookup(spark):
    rows = [("Orchard",), ("MARINA BAY",), (" orchard",), ("Nowhere",), (None,)]
    df = spark.createDataFrame(rows, "d string")
    got = [(r.p.lat, r.p.lon) for r in df.select(district_point(F.col("d")).alias("p")).collect()]
    assert got[0] == GAZETTEER["orchard"]
    assert got[1] == GAZETTEER["marina bay"]
    # no trim, unknown and missing districts use the default point
    assert got[2] == got[3] == got[4] == (1.29, 103.85)
    assert len(GAZETTEER) == 21
