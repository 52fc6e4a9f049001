"""Factored match = cross-join brute force on random catalogs and intents.

Category texts are drawn from a small alphabet of words so that short terms,
substrings across word boundaries, empty strings and case variants hit the
gram join; coordinates, ratings, prices and discounts include NULL,
negative and out-of-range values.
"""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dealgrid.operators.catalog import build_catalog
from dealgrid.operators.intent import fixture_intents
from dealgrid.operators.match import top_merchants
from dealgrid.operators.requests import request_asks
from dealgrid.plans.sizing import materialize

from test_match import brute_force

WORDS = ["food", "spa", "sports", "park", "kids", "japanese", "fine dining", "gifts",
         "florist", "solo", "family", "gym", "tea", "a", "od", "Food", "Theme Park"]
CATS = ["food", "Food", "activities", "gifts", "travel", "general", "General", "", "a",
        "oo", "spa", "park", "fine din", "ODS"]
PRICES = [None, "", "cheap", "mid-range", "expensive", "under $50", "$10-$90", "$30",
          "around 40", "about 5", "20", "-20", "$50-$20", "garbage"]
DISTRICTS = ["Orchard", "Jurong", "Changi", "Nowhere", None, "MARINA BAY"]
ITEM_WORDS = ["sushi", "tea", "cake", "massage", "ticket", "rose", "ring", "noodle"]


def _text(rng, n=2):
    if rng.random() < 0.1:
        return None
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, n)))


def _data(seed):
    rng = random.Random(seed)
    merchants, items = [], []
    for mid in range(1, 61):
        lat = None if rng.random() < 0.1 else round(1.25 + rng.random() * 0.15, 4)
        lon = None if lat is None else round(103.65 + rng.random() * 0.35, 4)
        rating = None if rng.random() < 0.15 else round(rng.uniform(1, 5), 1)
        merchants.append((mid, 1000 - mid * 7 % 61, f"m{mid}", _text(rng), _text(rng, 1),
                          rating, lat, lon, "x"))
        for pos in range(rng.randint(0, 4)):
            price = rng.choice([None, -1.0, round(rng.uniform(0, 150), 2), 20.0, 40.0])
            disc = rng.choice([None, 0.0, 10.0, 50.0, 150.0, -5.0])
            name = " ".join(rng.sample(ITEM_WORDS, 2))
            items.append((mid, pos, name, price, disc))
    intents = []
    for iid in range(40):
        r = rng.random
        intents.append((
            iid, rng.choice(CATS + [None] if iid % 13 == 0 else CATS), rng.choice(PRICES),
            None if r() < 0.5 else rng.choice([0.0, 3.0, 8.0, 30.0]),
            None if r() < 0.6 else rng.choice([0.0, 2.5, 4.0]),
            None if r() < 0.7 else "|".join(rng.sample(["SUSHI", "tea", "ros", "cake", ""], rng.randint(1, 2))),
            rng.choice([None, "japanese", "thai", ""]), rng.choice([None, "fine", "quiet"]),
            rng.choice([None, "family", "couple", "Family"]), r() < 0.3,
            rng.choice([None, "sports", "Sports"]), rng.choice([None, "mother", "Mother", "father"]),
            r() < 0.3, r() < 0.2, rng.choice(["high", "low", "medium", None]),
            None if r() < 0.5 else "|".join(rng.sample(["spa", "park", "Spa", "tea", "kids"], 2)),
        ))
    requests = [(rid, rid % 9, rid % 40) for rid in range(200)]
    customers = [(c, rng.choice(DISTRICTS)) for c in range(8)]  # customer 8 is unknown
    return merchants, items, intents, requests, customers


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_factored_equals_cross_join(spark, seed):
    merchants, items, intents, requests, customers = _data(seed)
    m = spark.createDataFrame(
        merchants,
        "merchant_id long, pos long, name string, category string, primary_category string, "
        "rating double, lat double, lon double, district string",
    )
    it = spark.createDataFrame(
        items, "merchant_id long, pos long, name string, price double, discount_percent double"
    )
    fi = spark.createDataFrame(
        intents,
        "intent_id int, category string, price_range string, proximity_km double, "
        "min_rating double, exact_items string, cuisine string, atmosphere string, "
        "participants string, solo boolean, activity_type string, recipient string, "
        "is_generic boolean, is_ambiguous boolean, confidence string, preferences string",
    )
    req = spark.createDataFrame(requests, "request_id long, customer_id long, intent_id int")
    cust = spark.createDataFrame(customers, "consumer_id long, district string")
    asks = materialize(request_asks(req.join(fixture_intents(fi), "intent_id"), cust))
    catalog = build_catalog(m, it)
    fast = top_merchants(asks, catalog, score_digits=6).select(
        "request_id", "rank", "merchant_id", F.round("dist_km", 6).alias("dist_km"),
        F.round("score", 6).alias("score"))
    a = sorted(tuple(r) for r in fast.collect())
    b = sorted(tuple(r) for r in brute_force(asks, catalog).collect())
    assert len(a) > 50
    assert a == b
