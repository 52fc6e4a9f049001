"""Prompts due between inference runs: decoded quotes, gates, repeats and late answers."""

from __future__ import annotations

import json

import pytest

from dealgrid.operators import cycle, render

FIRST = '{"category": "food", "is_generic": true, "specifics": {"cuisine": "thai"}, "price_range": null}'
SCHEMA = "request_id long, step int, content string"


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(i, f"text {i}", f"profile {i}", f"short {i}") for i in range(1, 7)]
    rows.append((9, "from nobody", None, None))
    return spark.createDataFrame(rows, "request_id long, user_request string, profile string, offer_profile string")


def due(spark, requests, answered, offers=None):
    rows = cycle.due_prompts(requests, spark.createDataFrame(answered, SCHEMA), offers).collect()
    found = {(r.request_id, r.step): r.text for r in rows}
    assert len(found) == len(rows)
    return found


def test_first_round_asks_known_customers(spark, requests):
    out = due(spark, requests, [])
    assert set(out) == {(i, 1) for i in range(1, 7)}
    assert out[2, 1].endswith("text 2")


def test_refinement_quotes_the_decoded_first_reading(spark, requests):
    answered = [(1, 1, f"Sure! {FIRST} bye"), (2, 1, "no idea"), (3, 1, None), (4, 1, "[1]"), (5, 1, "{}")]
    out = due(spark, requests, answered)
    assert set(out) == {(1, 2), (2, 2), (3, 2), (4, 2), (5, 2), (6, 1)}

    def quoted(i: int):
        a, b, c, d = render.REFINE_PARTS
        text = out[i, 2]
        return json.loads(text[text.index(b) + len(b) : text.index(c)])

    assert quoted(1) == json.loads(FIRST)
    default = {"category": "general", "is_generic": True, "confidence": "low", "specifics": {}}
    assert quoted(2) == quoted(3) == quoted(5) == default
    assert quoted(4) == [1]


def test_generic_requests_are_asked_for_preferences_and_then_offered(spark, requests):
    plain = '{"category": "gifts", "confidence": "high"}'
    answered = [(i, 1, FIRST) for i in range(1, 6)]
    answered += [(1, 2, plain), (2, 2, None), (3, 2, '{"category": 5}'), (4, 2, FIRST), (4, 3, None), (5, 2, plain)]
    answered += [(5, 4, "an offer")]
    assert set(due(spark, requests, answered)) == {(2, 3), (6, 1)}
    offers = spark.createDataFrame([(i, f"merchants {i}") for i in (1, 2, 3, 4, 5)], "request_id long, summary string")
    out = due(spark, requests, answered, offers)
    # 3 cannot be used, 5 has its offer, 2 still waits for preferences
    assert set(out) == {(1, 4), (2, 3), (4, 4), (6, 1)}
    assert "short 1" in out[1, 4] and "merchants 1" in out[1, 4] and '"category":"gifts"' in out[1, 4]
    assert "food" in out[2, 3]


def test_repeats_and_empty_tables(spark, requests):
    answered = [(1, 1, "a"), (1, 1, FIRST), (1, 1, FIRST)]
    once, twice = due(spark, requests, answered), due(spark, requests, answered + answered)
    assert once == twice and "thai" in once[1, 2]
    assert due(spark, requests.limit(0), answered) == {}
