"""Budget text parsing: every case of SURVEY table 2.3.1 and more."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from dealgrid.functions.pricing import discounted_price, price_bounds_object, with_price_bounds
from dealgrid.functions.text import py_float

INF = math.inf

CASES = [
    (None, (0, INF)),
    ("", (0, INF)),
    ("around 50", (40, 60)),
    ("about 5", (0, 15)),
    ("around 1,000", (0, 11)),
    ("cheap", (0, 20)),
    ("mid-range", (20, 100)),
    ("expensive", (100, INF)),
    ("under $50", (0, 50)),
    ("under $50 each", (0, INF)),
    ("$10-$50", (10, 50)),
    ("$50", (50, INF)),
    ("$10-", (10, INF)),
    ("$1,000", (0, INF)),
    ("around $50", (0, INF)),
    ("$50-$20", (50, 20)),
    ("20", (10, 30)),
    ("sgd 5", (0, 15)),
    ("-20", (0, -10)),
    ("10-50", (0, INF)),
    ("under 50", (0, INF)),
    ("mid range", (0, INF)),
    # more
    ("SGD 30", (20, 40)),
    ("Cheap", (0, 20)),
    ("  cheap  ", (0, 20)),
    ("sgd", (0, INF)),
    ("about 100 sgd", (90, 110)),
    ("around sgd 50", (40, 60)),
    ("about 7.5", (0, 17.5)),
    ("120.5", (110.5, 130.5)),
    ("0", (0, 10)),
    ("$10-$90", (10, 90)),
    ("$10-$50-$70", (10, 50)),
    ("-$5", (0, INF)),
    ("$ 10 - 20 ", (10, 20)),
    ("under $abc", (0, INF)),
    ("1e2", (90, 110)),
    ("inf", (INF, INF)),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string")
    out = with_price_bounds(df, "t").select("i", "budget.lo", "budget.hi").collect()
    return {r["i"]: (r["lo"], r["hi"]) for r in out}


@pytest.mark.parametrize("idx", range(len(CASES)))
def test_price_text(parsed, idx):
    text, (lo, hi) = CASES[idx]
    assert parsed[idx] == (float(lo), float(hi)), text


def test_nan_text_matches_nothing(spark):
    df = with_price_bounds(spark.createDataFrame([("nan",)], "t string"), "t")
    lo, hi = df.select("budget.lo", "budget.hi").first()
    # max(0, nan - 10) is 0 in Python; the upper bound stays NaN
    assert lo == 0.0 and math.isnan(hi)


def test_py_float(spark):
    vals = [" 12 ", "1e3", "5.", ".5", "+3", "-inf", "NaN", "1_000", "1_0.2_5e1_0", "abc", "",
            None, "12.5.1", "1__0", "_1", "1_", "1._5"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(py_float(F.col("t"))).collect()]
    assert got[:5] == [12.0, 1000.0, 5.0, 0.5, 3.0]
    assert got[5] == -INF and math.isnan(got[6])
    assert got[7:9] == [1000.0, float("1_0.2_5e1_0")]
    assert got[9:] == [None] * 8


def test_price_object(spark):
    rows = ['{"min": 10, "max": 50}', '{"min": "5"}', '{"max": null}', '{}', '{"min": [1]}',
            '{"min": true, "max": "20"}']
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [
        (r["lo"], r["hi"])
        for r in df.select(price_bounds_object(F.parse_json("j")).alias("b"))
        .select("b.lo", "b.hi")
        .collect()
    ]
    assert got == [(10.0, 50.0), (5.0, INF), (0.0, INF), (0.0, INF), (0.0, INF), (1.0, 20.0)]


def test_discounted_price(spark):
    rows = [(100.0, 10.0), (100.0, 150.0), (100.0, -5.0), (100.0, None), (-1.0, 0.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "p double, d double")
    got = [r[0] for r in df.select(discounted_price(F.col("p"), F.col("d"))).collect()]
    assert got == [90.0, 100.0, 100.0, 100.0, None, None]


def test_display_rounding_matches_python(spark):
    from dealgrid.functions.text import fmt_fixed

    vals = [7.425, 2.675, 0.125, 2.5, 3.5, -0.4, -1.005, 1234567.891, 0.005, 7.5 * 0.99, 1.15]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (0, 1, 2):
        got = [r[0] for r in df.select(fmt_fixed(F.col("x"), d)).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]


def test_unicode_whitespace_like_python(spark):
    from pyspark.sql import types as T

    from dealgrid.functions.ids import plain_key

    vals = [" 50　", " cheap ", "around 40", "\x1c7\x1f"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    floats = [r[0] for r in df.orderBy("i").select(py_float(F.col("t"))).collect()]
    assert floats[0] == float(vals[0]) == 50.0
    assert floats[3] is None  # float() does not strip U+001C..U+001F (strip() does)
    bounds = {r.i: (r.lo, r.hi) for r in with_price_bounds(df, "t").select("i", "budget.lo", "budget.hi").collect()}
    assert bounds[1] == (0.0, 20.0) and bounds[2] == (30.0, 50.0)
    keys = [r[0] for r in df.orderBy("i").select(plain_key(F.col("t"), T.StringType())["key"]).collect()]
    assert keys[0] == str(int(vals[0])) == "50"


def test_number_and_text_repr_like_python(spark):
    from dealgrid.functions.text import py_float_repr, py_str_repr

    numbers = [0.0, -0.0, 1.0, 12.5, 12345678.5, 1e15, 1e16, 1.5e16, 0.001, 0.0001, 1e-5, 1.5e-7,
               0.1 + 0.2, -420.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(py_float_repr(F.col("x"))).collect()]
    assert got == [repr(x) for x in numbers]
    texts = ["a", "it's", 'say "x"', "both ' \"", "back\\slash", "line\nbreak\t", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(py_str_repr(F.col("x"))).collect()]
    assert got == [repr(x) for x in texts]
