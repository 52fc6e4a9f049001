"""Budget parsing and discounted prices.

``with_price_bounds(df, text_col)`` adds ``struct<lo double, hi double>``; an open upper
bound is ``+Infinity``. Rules are tried in order on the text after
lower-casing, removing every ``sgd`` and stripping whitespace:

1. NULL or empty input           -> (0, inf)
2. "around N" / "about N"        -> (max(0, N-10), N+10) when the regex finds N
3. "cheap" / "mid-range" / "expensive" (whole text)
4. contains "under $"            -> (0, rest as number) else (0, inf)
5. contains "$"                  -> drop "$", split on "-": (first, second or inf)
6. plain number N                -> (max(0, N-10), N+10)
7. anything else                 -> (0, inf)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.jsonx import py_float_variant
from dealgrid.functions.text import PY_WS, py_float, py_max0, py_strip

INF = float("inf")

# --- Fixed values (budget words and their ranges, in rule order) ----------
BUDGET_WORDS: dict[str, tuple[float, float]] = {
    "cheap": (0.0, 20.0),
    "mid-range": (20.0, 100.0),
    "expensive": (100.0, INF),
}
# Half-width of the window put around a single amount ("around 50", "30").
AMOUNT_SPREAD = 10.0
# Pattern that finds the amount after "around" / "about".
APPROX_PATTERN = r"around\s*(\d+(?:\.\d+)?)|about\s*(\d+(?:\.\d+)?)"
# (``\s`` above means Python's Unicode whitespace; the Spark pattern below
# spells that class out.)
_APPROX_SPARK = APPROX_PATTERN.replace(r"\s", PY_WS)
# --------------------------------------------------------------------------


def _bounds(lo: Column | float, hi: Column | float) -> Column:
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.struct(lo_c.cast("double").alias("lo"), hi_c.cast("double").alias("hi"))


def _around(x: Column) -> Column:
    return _bounds(py_max0(x - AMOUNT_SPREAD), x + AMOUNT_SPREAD)


def with_price_bounds(df: DataFrame, text_col: str, out: str = "budget") -> DataFrame:
    """Add ``out = struct<lo, hi>`` (never NULL) parsed from ``text_col``.

    The rules run as staged projections: the cleaned text and each candidate
    number are computed once per row, and Catalyst keeps them as separate
    projections (it does not re-inline a non-trivial expression that is used
    several times), which keeps the generated code small.
    """
    text = F.col(text_col)
    t = df.withColumn("_pb_s", py_strip(F.replace(F.lower(text), F.lit("sgd"), F.lit(""))))
    s = F.col("_pb_s")
    t = t.withColumn(
        "_pb_approx_txt",
        F.coalesce(
            F.nullif(F.regexp_extract(s, _APPROX_SPARK, 1), F.lit("")),
            F.nullif(F.regexp_extract(s, _APPROX_SPARK, 2), F.lit("")),
        ),
    ).withColumn("_pb_parts", F.split(F.replace(s, F.lit("$"), F.lit("")), "-"))
    parts = F.col("_pb_parts")
    t = t.select(
        "*",
        py_float(F.col("_pb_approx_txt")).alias("_pb_approx"),
        py_float(F.replace(s, F.lit("under $"), F.lit(""))).alias("_pb_under"),
        py_float(F.get(parts, 0)).alias("_pb_first"),
        ((F.size(parts) > 1) & (py_strip(F.get(parts, 1)) != "")).alias("_pb_has_second"),
        py_float(F.get(parts, 1)).alias("_pb_second"),
        py_float(s).alias("_pb_plain"),
    )
    approx, under = F.col("_pb_approx"), F.col("_pb_under")
    first, second, plain = F.col("_pb_first"), F.col("_pb_second"), F.col("_pb_plain")
    open_range = _bounds(0.0, INF)
    dollar = (
        F.when(first.isNull(), open_range)
        .when(~F.col("_pb_has_second"), _bounds(first, INF))
        .when(second.isNull(), open_range)
        .otherwise(_bounds(first, second))
    )
    chain = F.when(text.isNull() | (text == ""), open_range).when(
        (s.contains("around") | s.contains("about")) & approx.isNotNull(), _around(approx)
    )
    for word, (lo, hi) in BUDGET_WORDS.items():
        chain = chain.when(s == word, _bounds(lo, hi))
    chain = (
        chain.when(
            s.contains("under $"),
            F.when(under.isNotNull(), _bounds(0.0, under)).otherwise(open_range),
        )
        .when(s.contains("$"), dollar)
        .when(plain.isNotNull(), _around(plain))
        .otherwise(open_range)
    )
    return t.withColumn(out, chain).drop(*[c for c in t.columns if c.startswith("_pb_")])




def price_bounds_object(obj: Column) -> Column:
    """Budget given as a JSON object ``{"min":..,"max":..}`` (VARIANT).

    Absent ``min`` -> 0, absent ``max`` -> inf; if either present value cannot
    be converted (an explicit null included), both reset to (0, inf).
    """
    min_v = F.variant_get(obj, "$.min", "variant")
    max_v = F.variant_get(obj, "$.max", "variant")
    lo = F.when(min_v.isNull(), F.lit(0.0)).otherwise(py_float_variant(min_v))
    hi = F.when(max_v.isNull(), F.lit(INF)).otherwise(py_float_variant(max_v))
    return F.when(lo.isNull() | hi.isNull(), _bounds(0.0, INF)).otherwise(_bounds(lo, hi))


def effective_discount(discount: Column) -> Column:
    """Discount percent as used for matching: a number in [0, 100] stays, NaN
    stays (it poisons the price), anything else counts as 0."""
    return (
        F.when(F.isnan(discount), discount)
        .when((discount >= 0) & (discount <= 100), discount)
        .otherwise(F.lit(0.0))
    )


def discounted_price(price: Column, discount: Column) -> Column:
    """``price * (1 - d / 100)`` for a valid price (a number >= 0), else NULL.
    NaN prices stay NaN; callers drop them because no range test accepts NaN."""
    d = effective_discount(F.coalesce(discount, F.lit(0.0)))
    valid = price.isNotNull() & (F.isnan(price) | (price >= 0))
    return F.when(valid, price * (1 - d / 100))
