"""Text helpers shared by the operators.

All of them are built-in column expressions, so they stay inside whole-stage
codegen; nothing here is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python sees it (``str.isspace``, used by ``strip``, ``float``,
# ``int`` and ``re``'s ``\s``); Java's ``\s`` and Spark's ``trim`` know only
# ASCII. The class is valid in Java regexes and in RE2.
PY_WS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# ``float()`` and ``int()`` strip the same set except U+001C..U+001F.
PY_NUM_WS = (
    r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_EDGE_WS = rf"^{PY_WS}+|{PY_WS}+$"
# Text Python's ``float()`` accepts: ASCII digits, underscores only between
# digits (non-ASCII digits are a stated difference).
_DIGITS = r"\d(?:_?\d)*"
_DECIMAL = (
    rf"(?i)^{PY_NUM_WS}*[+-]?({_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?{PY_NUM_WS}*$"
)
_SPECIAL = rf"(?i)^{PY_NUM_WS}*([+-]?)(inf|infinity|nan){PY_NUM_WS}*$"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_WS, "")


def py_float(text: Column) -> Column:
    """Python ``float(text)`` for a string column; NULL where Python raises."""
    special = F.lower(F.regexp_extract(text, _SPECIAL, 2))
    sign = F.regexp_extract(text, _SPECIAL, 1)
    inf = F.when(sign == "-", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(text.rlike(_DECIMAL), F.replace(py_strip(text), F.lit("_"), F.lit("")).try_cast("double"))
        .when(special == "nan", F.lit(float("nan")))
        .when(special != "", inf)
    )


def py_max0(x: Column) -> Column:
    """Python ``max(0, x)``: NaN and negatives give 0 (Spark's ``greatest``
    would return NaN, which it orders above every number)."""
    return F.when(~F.isnan(x) & (x > 0), x).otherwise(F.lit(0.0))


def lower_or_empty(c: Column) -> Column:
    """``(value or '').lower()``."""
    return F.lower(F.coalesce(c, F.lit("")))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """OR of ``contains`` over a constant word list, built at plan time so it
    stays a plain codegen'd predicate."""
    out = None
    for w in words:
        term = text.contains(F.lit(w))
        out = term if out is None else (out | term)
    return out if out is not None else F.lit(False)


def fmt_fixed(x: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"``: ``format_number`` rounds half-even on the exact
    binary value, as Python does (``format_string`` would round the shortest
    decimal half-up: 7.425 -> "7.43" instead of "7.42"); its grouping commas
    are removed and NaN / infinities are spelled as in Python."""
    text = F.regexp_replace(F.format_number(x, digits), ",", "")
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it reads many times: computed once, and not
    repeated in the generated code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_float_repr(x: Column) -> Column:
    """``repr(float)``: the shortest digits, without an exponent from 1e-4 up to
    1e16, else like ``1.5e-07`` (Spark's cast switches at 1e-3 and 1e7)."""
    return let(x, lambda v: let(v.cast("string"), lambda short: _float_repr(v, short)))


def _float_repr(x: Column, short: Column) -> Column:
    plain = F.regexp_replace(
        F.regexp_replace(short.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    digits = F.abs(power).cast("string")
    digits = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    size = F.abs(x)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, F.when(short.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )


def py_str_repr(c: Column) -> Column:
    """``repr(str)``; NULL prints as ``None``. Double quotes when the text holds a
    single quote and no double one; backslashes, the quote used and line breaks are
    escaped (other control characters are a stated difference)."""
    text = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    double = c.contains("'") & ~c.contains('"')
    return (
        F.when(c.isNull(), F.lit("None"))
        .when(double, F.concat(F.lit('"'), text, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )
