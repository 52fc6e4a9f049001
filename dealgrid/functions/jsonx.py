"""Strict JSON decoding of text columns.

Spark's ``try_parse_json`` stops after the first complete value and ignores
what follows (``'{"a":1} and more'`` parses as ``{"a":1}``), while a strict
decoder rejects trailing content. ``with_json_strict`` wraps the text as
``[<text>, "<end marker>"]``: the wrapper parses into exactly two elements
with the marker second only when the text is one complete JSON value with
nothing after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.text import let, py_float, py_float_repr

DUPLICATE_KEYS_CONF = "spark.sql.variant.allowDuplicateKeys"
_END = "~dealgrid:end-of-value~"


def with_json_strict(df: DataFrame, text: Column | str, out: str) -> DataFrame:
    """Add ``out``: the VARIANT of ``text`` when it is exactly one JSON value, else
    NULL. Staged projections: the
    wrapper is parsed once per row and the checks read the parsed column
    (a single expression would repeat the parse inside every branch). Sets
    ``DUPLICATE_KEYS_CONF`` for the session: the last of repeated keys wins."""
    t = F.col(text) if isinstance(text, str) else text
    # without this an object with a repeated key fails to parse, and its record or
    # response would be lost; Python keeps the key's last value
    df.sparkSession.conf.set(DUPLICATE_KEYS_CONF, "true")
    tmp = f"_{out}_wrapped"
    w = df.withColumn(tmp, F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{_END}"]'))))
    wrapped = F.col(tmp)
    ok = (F.try_variant_get(wrapped, "$[1]", "string") == _END) & F.try_variant_get(
        wrapped, "$[2]", "variant"
    ).isNull()
    return w.withColumn(out, F.when(ok, F.try_variant_get(wrapped, "$[0]", "variant"))).drop(tmp)


# --- VARIANT helpers shared by the decoders ---------------------------------

_NUMBER_KINDS = ("BIGINT", "DOUBLE", "FLOAT")


def kind(v: Column) -> Column:
    """Type name of a VARIANT value (``BIGINT``, ``STRING``, ``OBJECT<...>``...)."""
    return F.schema_of_variant(v)


def is_number_kind(k: Column) -> Column:
    return k.isin(*_NUMBER_KINDS) | k.startswith("DECIMAL")


def field(v: Column, path: str) -> Column:
    """VARIANT field: SQL NULL when absent, VARIANT null when JSON null."""
    return F.variant_get(v, f"$.{path}", "variant")


def text_value(v: Column) -> Column:
    """The string of a JSON string value, else NULL."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def py_float_variant(v: Column) -> Column:
    """Python ``float(value)`` of a VARIANT: numbers, booleans and numeric
    text convert; null, lists, objects and other text give NULL."""
    k = kind(v)
    return (
        F.when(is_number_kind(k) | (k == "BOOLEAN"), F.try_variant_get(v, "$", "double"))
        .when(k == "STRING", py_float(F.try_variant_get(v, "$", "string")))
    )


def strict_number(v: Column) -> Column:
    """A JSON number (booleans count as 1/0); anything else is NULL."""
    k = kind(v)
    return F.when(is_number_kind(k) | (k == "BOOLEAN"), F.try_variant_get(v, "$", "double"))


def json_truthy(v: Column) -> Column:
    """Python truthiness of a decoded JSON value (SQL NULL -> false)."""
    k = kind(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(is_number_kind(k), F.try_variant_get(v, "$", "double") != 0)
        .when(k == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(k.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(k.startswith("OBJECT"), k != "OBJECT<>")
        .otherwise(F.lit(False))
    )


def py_str_variant(v: Column) -> Column:
    """``str(value)`` of a JSON scalar, NULL for null, lists and objects."""

    def of(k: Column) -> Column:
        text = F.to_json(v)
        return (
            F.when(k == "STRING", F.try_variant_get(v, "$", "string"))
            .when(k == "BIGINT", text)
            .when(k == "BOOLEAN", F.initcap(text))
            # an integer too long for BIGINT; shorter ones were written with ".0"
            .when(k.startswith("DECIMAL") & ~text.contains(".") & (F.length(text) >= 19), text)
            .when(is_number_kind(k), py_float_repr(F.try_variant_get(v, "$", "double")))
        )

    return let(kind(v), of)


def exact_number_text(v: Column) -> Column:
    """Canonical text of a JSON number, equal for equal numbers: booleans are 1
    and 0, whole numbers of any length their digits, others their shortest form."""

    def of_double(d: Column) -> Column:
        whole = d == F.floor(d.try_cast("decimal(38,1)"))
        return F.when(whole & (F.abs(d) < 1e37), d.try_cast("decimal(38,0)").cast("string")).otherwise(
            py_float_repr(d)
        )

    def of_decimal(text: Column) -> Column:
        # plain digits; trailing zeros of the fraction do not count
        short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(short == "-0", F.lit("0")).otherwise(short)

    def of(k: Column) -> Column:
        return (
            F.when(k == "BIGINT", F.to_json(v))
            .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("string"))
            .when(k.startswith("DECIMAL"), let(F.to_json(v), of_decimal))
            .when(is_number_kind(k), let(F.try_variant_get(v, "$", "double"), of_double))
        )

    return let(kind(v), of)


def truncated_number_text(v: Column) -> Column:
    """``str(int(value))`` of a JSON number or boolean, exact for any length; NULL
    beyond 37 digits."""

    def of(text: Column) -> Column:
        whole = F.regexp_extract(text, r"^(-?\d+)", 1)
        return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.when(whole == "-0", F.lit("0")).otherwise(whole)).when(
            text.rlike(r"e-\d+$"), F.lit("0")
        )

    return let(exact_number_text(v), of)
