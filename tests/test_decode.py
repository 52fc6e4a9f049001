"""Model-response decoding, intent resolution and quarantine (F12, F13,
O1, O2, §7.4)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dealgrid.operators import decode


def test_decode_object(spark):
    rows = ["", "   ", '  {"a": 1}  ', 'Sure: {"a": 1} ok', "x {bad} y",
            '{"a":1} and {"b":2}', "line\n{\n\"a\": 2\n}\nend", None, "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    got = [r.d_how for r in decode.with_decoded(df, "c", "d").orderBy("i").collect()]
    assert got == ["empty", "empty", "strict", "span", "none", "none", "span", "empty", "strict"]


def test_json_truthy(spark):
    rows = ["{}", '{"a":1}', "[]", "[0]", '""', '"x"', "0", "0.0", "2", "true", "false", "null"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [r[0] for r in df.select(decode.json_truthy(F.parse_json("j"))).collect()]
    assert got == [False, True, False, True, False, True, False, False, True, True, False, False]


def _resolve(spark, c1, c2):
    df = spark.createDataFrame([(1, 1, c1), (1, 2, c2)], "request_id long, step int, content string")
    r = decode.resolve_intents(df).select(
        "source", F.variant_get("intent", "$.category", "string").alias("cat")
    ).first()
    return r.source, r.cat


@pytest.mark.parametrize(
    "c1,c2,expected",
    [
        ('{"category": "food"}', '{"category": "travel"}', ("refined", "travel")),
        ('{"category": "food"}', "no json", ("initial", "food")),
        ('{"category": "food"}', "{}", ("initial", "food")),
        ('{"category": "food"}', "", ("initial", "food")),
        ("", '{"category": "gifts"}', ("refined", "gifts")),
        ("nothing", None, ("default", "general")),
        ("null", "0", ("default", "general")),
    ],
)
def test_resolve(spark, c1, c2, expected):
    assert _resolve(spark, c1, c2) == expected


def test_decode_list(spark):
    rows = ['["japanese", "quiet", "japanese"]', '{"a": 1}', "bad", '["x", 1, ["y"]]', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    got = [sorted(r.p) for r in decode.with_decoded_list(df, "c", "p").orderBy("i").collect()]
    assert got == [["japanese", "quiet"], [], [], ["x"], []]


STATUS = [
    ('{"confidence": "high"}', "ok"),
    ('{"category": null}', "invalid_category"),
    ('{"category": 5}', "invalid_category"),
    ('{"category": "food", "price_range": 5}', "invalid_price_range"),
    ('{"category": "food", "price_range": 0}', "ok"),
    ('{"category": "food", "price_range": {"min": 5}}', "ok"),
    ('{"category": "food", "specifics": null}', "invalid_specifics"),
    ('{"category": "travel", "specifics": null}', "ok"),
    ('{"category": "food", "specifics": {"cuisine": 3}}', "invalid_specifics"),
    ('{"category": "food", "exact_items": "cake"}', "invalid_exact_items"),
    ('{"category": "food", "exact_items": []}', "ok"),
    ("[1, 2]", "invalid_intent"),
]


def test_typed_intents(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(STATUS)], "i int, j string")
    df = df.withColumn("v", F.parse_json("j"))
    out = decode.typed_intents(df, "v", keep=("i",)).orderBy("i").collect()
    assert [r.intent_status for r in out] == [s for _, s in STATUS]
    assert out[0].category == "general" and out[0].confidence == "high"
    assert (out[5].budget.lo, out[5].budget.hi) == (5.0, float("inf"))


def test_typed_fields(spark):
    j = ('{"category": "food", "proximity_km": "5", "min_rating": "4", '
         '"exact_items": ["Cake"], "is_generic": "yes", "specifics": {"solo": 1}}')
    df = spark.createDataFrame([(j,)], "j string").withColumn("v", F.parse_json("j"))
    r = decode.typed_intents(df, "v").first()
    assert r.proximity_km is None and r.min_rating == 4.0
    assert r.exact_items == ["Cake"] and r.is_generic is True and r.specifics.solo is True
    assert r.confidence == "medium"


def test_duplicate_keys_keep_the_last_value(spark):
    df = spark.createDataFrame([(1, 1, '{"category": "food", "category": "gifts"}'),
                                (1, 2, "")], "request_id long, step int, content string")
    r = decode.resolve_intents(df).select(
        "source", F.variant_get("intent", "$.category", "string").alias("cat")).first()
    assert (r.source, r.cat) == ("initial", "gifts")
