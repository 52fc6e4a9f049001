"""JSON lines in, offers out: dimensions from JSON-lines files, intents from
model text, the match, the log row and the leaderboard, on the API a user of
the library calls (not the driver fixtures)."""

from __future__ import annotations

import math
import os

from pyspark.sql import functions as F

from dealgrid.operators import decode, exposure, render
from dealgrid.operators.match import top_merchants
from dealgrid.operators.requests import request_asks
from dealgrid.sources import jsonl

MERCHANTS = [
    '{"merchant_id": 101, "name": "Sushi Go", "category": "Japanese fine dining", '
    '"primary_category": "Food", "rating": 4.6, "lat": 1.3048, "lon": 103.8318, '
    '"address": {"district": "Orchard"}, "items": [{"name": "Salmon sushi", "price": 30, '
    '"discount_percent": 10}]}',
    '{"merchant_id": "m-7", "name": "Noodle Bar", "category": "Hawker Chinese", '
    '"primary_category": "Food", "rating": "4.0", "items": [{"name": "Noodles", "price": 8}]}',
    '{"merchant_id": 102, "name": "Rose", "category": "Florist gifts", "primary_category": "Gifts", '
    '"rating": 4.1, "items": [{"name": "Roses", "price": 60}]}',
    '{"merchant_id": 101, "name": "Sushi Go!", "category": "Japanese fine dining", '
    '"primary_category": "Food", "rating": 4.6, "lat": 1.3048, "lon": 103.8318, '
    '"address": {"district": "Orchard"}, "items": [{"name": "Salmon sushi", "price": 30, '
    '"discount_percent": 10}]}',
]


def _km(a, b):
    (la1, lo1), (la2, lo2) = a, b
    h = (math.sin(math.radians(la2 - la1) / 2) ** 2
         + math.cos(math.radians(la1)) * math.cos(math.radians(la2))
         * math.sin(math.radians(lo2 - lo1) / 2) ** 2)
    return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_json_lines_to_offers(spark, scratch):
    m_path = os.path.join(scratch, "merchants.jsonl")
    with open(m_path, "w", encoding="utf-8") as f:
        f.write("\n".join(MERCHANTS) + "\n")
    here = os.path.dirname(os.path.abspath(__file__))
    catalog, customers = jsonl.load_dimensions(
        spark, m_path, os.path.join(here, "data", "customers.jsonl")
    )
    responses = spark.createDataFrame(
        [
            (1, 1, 'Here you go: {"category": "food", "price_range": "under $40", '
                   '"proximity_km": 5, "specifics": {"cuisine": "japanese"}} thanks'),
            (1, 2, ""),
            (2, 1, '{"category": "food", "exact_items": ["NOODLE"]}'),
            (3, 1, "not json"),
        ],
        "request_id long, step int, content string",
    )
    resolved = decode.resolve_intents(responses)
    typed = decode.typed_intents(resolved, "intent", "deduced_preferences", keep=("request_id",))
    requests = spark.createDataFrame(
        [(1, "71"), (2, " 8 "), (3, "71")], "request_id long, customer_id string"
    ).join(typed, "request_id")
    asks = request_asks(requests, customers)
    offers = top_merchants(asks, catalog).orderBy("request_id", "rank").collect()
    got = [(r.request_id, r.merchant_id, round(r.score, 6)) for r in offers]
    # request 1: Orchard customer, sushi bar 0 km away: 2 (primary) + 5 bonus;
    # the noodle bar misses the cuisine (-2) and sits at the default point:
    # 2 - 2 + 5 / (1 + d).
    d = _km((1.3048, 103.8318), (1.29, 103.85))
    assert got[0] == (1, "101", 7.0)
    assert got[1][0:2] == (1, "m-7") and abs(got[1][2] - 5 / (1 + d)) < 1e-5
    # request 2: exact item "noodle" (case-insensitive) only at the noodle bar
    assert (2, "m-7", 5.0) in got
    # request 3: undecodable text -> default generic intent, nothing scores
    assert all(r[0] != 3 for r in got)
    # the deduplicated record keeps the last line's name and the first position
    names = {r.merchant_id: r.name for r in catalog.collect()}
    assert names["101"] == "Sushi Go!"

    ids = (
        top_merchants(asks, catalog)
        .join(catalog.select("merchant_id", "id_json"), "merchant_id")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "id_json"))).alias("p"))
        .select(render.ids_json(F.transform("p", lambda x: x["id_json"])).alias("recommended_merchants"))
    )
    logged = {r.recommended_merchants for r in ids.collect()}
    assert '[101, "m-7"]' in logged
    # the loader's own catalog, as it is
    board = exposure.leaderboard(exposure.exposure_counts(ids), catalog).collect()
    assert {(r.merchant_key, r.key_kind, r.exposure, r.rating, r.district) for r in board} == {
        ("101", "number", 1, "4.6", "Orchard"), ("m-7", "text", 2, "4.0", "N/A")}
