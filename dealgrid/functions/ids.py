"""One rule for ids everywhere.

A key is ``(key_kind, key)``: kind ``number`` with the exact decimal digits, or
``text``. ``normalised_key`` (of a JSON value) and ``plain_key`` (of a typed
column) apply Python's ``int()``: integer text, truncated floats and booleans
become numbers, other text stays text, null is no key. ``logged_key`` keeps ids as
they were logged: text stays text, equal numbers are one id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.functions import jsonx as jx
from dealgrid.functions.text import PY_NUM_WS, let, py_float_repr

NUMBER, TEXT = "number", "text"
KEY_COLUMNS = ("key_kind", "key")
_INT_TEXT = rf"^{PY_NUM_WS}*[+-]?\d+(_\d+)*{PY_NUM_WS}*$"
_NOT_DIGITS = rf"{PY_NUM_WS}|_|^{PY_NUM_WS}*\+"


def _key(number: Column, text: Column) -> Column:
    def of(pair: Column) -> Column:
        kind = F.when(pair["n"].isNotNull(), F.lit(NUMBER)).otherwise(F.lit(TEXT))
        key = F.coalesce(pair["n"], pair["t"])
        return F.when(key.isNotNull(), F.struct(kind.alias("key_kind"), key.alias("key")))

    return let(F.struct(number.alias("n"), text.alias("t")), of)


def _int_of_text(s: Column) -> Column:
    """Digits of ``int(text)``, without leading zeros; NULL where it raises."""
    digits = F.regexp_replace(s, _NOT_DIGITS, "")
    short = F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")
    return F.when(s.rlike(_INT_TEXT), F.when(short == "-0", F.lit("0")).otherwise(short))


def normalised_key(raw: Column) -> Column:
    """``struct<key_kind, key>`` of a VARIANT id, NULL when missing or null."""
    s = F.when(jx.kind(raw) == "STRING", F.try_variant_get(raw, "$", "string"))
    number = F.coalesce(jx.truncated_number_text(raw), _int_of_text(s))
    text = F.coalesce(s, F.when(jx.is_number_kind(jx.kind(raw)), F.to_json(raw)))
    return F.when(raw.isNotNull() & ~F.is_variant_null(raw), _key(number, text))


def plain_key(c: Column, kind: T.DataType) -> Column:
    """The same rule for a column of any plain type."""
    if isinstance(kind, T.IntegralType):
        number = c.cast("string")
    elif isinstance(kind, T.BooleanType):
        number = c.cast("int").cast("string")
    elif isinstance(kind, T.DecimalType):
        number = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("string")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        d = c.cast("double")
        whole = F.when(d < 0, F.ceil(d.try_cast("decimal(38,10)"))).otherwise(
            F.floor(d.try_cast("decimal(38,10)"))
        )
        number = F.when(~F.isnan(d) & (F.abs(d) < 1e27), whole.cast("string"))
        return _key(number, py_float_repr(d))
    else:
        s = c.cast("string")
        return _key(_int_of_text(s), s)
    return _key(number, F.lit(None).cast("string"))


def logged_key(e: Column) -> Column:
    """``struct<key_kind, key>`` of a logged id; NULL for null, lists, objects."""
    text = F.when(jx.kind(e) == "STRING", F.try_variant_get(e, "$", "string"))
    return _key(jx.exact_number_text(e), text)
