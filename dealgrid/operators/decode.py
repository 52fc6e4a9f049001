"""Model responses -> intents and preferences (SURVEY F12, F13, O1, O2, O3,
§7.4).

Model text arrives as a table ``responses(request_id, step, content)``:
step 1 = first intent extraction, step 2 = refinement, step 3 = preference
list. Decoding is built-in JSON functions over VARIANT:

* ``with_decoded(df, content, out)``: strip; empty -> nothing; strict parse;
  else the widest ``{...}`` span (across lines) parsed; else nothing.
* ``resolve_intents``: initial = step 1 if it decoded to a truthy value, else
  the default intent; refined = step 2 if it decoded (strictly or from the
  span), else the initial one; final = refined when truthy, else initial.
  Whole objects are chosen, fields are never merged.
* ``typed_intents(df, col)``: VARIANT intent -> the typed columns of
  ``operators.intent`` with a quarantine ``intent_status`` for values the
  source application would crash on.

Duplicate keys inside one JSON object keep the last value, as in Python,
when ``spark.sql.variant.allowDuplicateKeys`` is on (``dealgrid.session``
sets it); otherwise such a response counts as undecodable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions import jsonx as jx
from dealgrid.functions.jsonx import json_truthy, with_json_strict
from dealgrid.functions.pricing import price_bounds_object, with_price_bounds
from dealgrid.functions.text import py_float, py_strip
from dealgrid.operators.intent import OK

STEP_EXTRACT, STEP_REFINE, STEP_PREFERENCES = 1, 2, 3
_SPAN = r"(?s)\{.*\}"
# --- Fixed values (intent used when the first extraction yields nothing) --
DEFAULT_INTENT_JSON = (
    '{"category": "general", "is_generic": true, "confidence": "low", "specifics": {}}'
)
# ---------------------------------------------------------------------------


def with_decoded(df: DataFrame, content: str, out: str) -> DataFrame:
    """Add ``out`` (VARIANT or NULL) and ``out_how`` (``empty``, ``strict``,
    ``span`` or ``none``) decoded from the text column ``content``: strip;
    empty -> nothing; strict parse; else the widest ``{...}`` span parsed.
    Staged projections, each parse runs once per row."""
    text_c, span_c = f"_{out}_text", f"_{out}_span_text"
    t = df.withColumn(text_c, py_strip(F.coalesce(F.col(content), F.lit(""))))
    t = t.withColumn(span_c, F.regexp_extract(F.col(text_c), _SPAN, 0))
    t = with_json_strict(t, text_c, f"_{out}_strict")
    t = with_json_strict(t, span_c, f"_{out}_span")
    text, strict, span = F.col(text_c), F.col(f"_{out}_strict"), F.col(f"_{out}_span")
    how = (
        F.when(text == "", F.lit("empty"))
        .when(strict.isNotNull(), F.lit("strict"))
        .when(span.isNotNull(), F.lit("span"))
        .otherwise(F.lit("none"))
    )
    return t.select(
        *df.columns,
        F.when(text != "", F.coalesce(strict, span)).alias(out),
        how.alias(f"{out}_how"),
    )


def with_decoded_list(df: DataFrame, content: str, out: str) -> DataFrame:
    """Add ``out``: preference list decoded strictly (no span fallback); a
    non-list gives an empty list; only text members are kept (stated
    difference for other members)."""
    t = with_json_strict(
        df, py_strip(F.coalesce(F.col(content), F.lit(""))), f"_{out}_v"
    )
    arr = F.try_variant_get(F.col(f"_{out}_v"), "$", "array<variant>")
    texts = F.transform(
        F.filter(arr, lambda e: jx.kind(e) == "STRING"),
        lambda e: F.try_variant_get(e, "$", "string"),
    )
    value = F.coalesce(F.array_distinct(texts), F.array().cast("array<string>"))
    return t.select(*df.columns, value.alias(out))


def steps_wide(responses: DataFrame) -> DataFrame:
    """``request_id, c1, c2, c3``: one row per request (pivot on a fixed step
    list, a grouped aggregation with no driver round trip). Should a request have
    several responses for a step, the greatest text counts, whatever their order."""
    # decoding costs far more than its bytes suggest: keep the session's number of
    # partitions instead of letting small ones be merged
    n = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        responses.repartition(n, "request_id")
        .groupBy("request_id")
        .pivot("step", [STEP_EXTRACT, STEP_REFINE, STEP_PREFERENCES])
        .agg(F.max("content"))
        .select(
            "request_id",
            F.col(str(STEP_EXTRACT)).alias("c1"),
            F.col(str(STEP_REFINE)).alias("c2"),
            F.col(str(STEP_PREFERENCES)).alias("c3"),
        )
    )


def resolved(wide: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``wide`` holds ``request_id`` and the responses ``c1, c2, c3``. Returns the ``keep``
    columns and ``request_id, initial (variant), intent (variant), source,
    deduced_preferences``; ``initial`` is the first reading, which the refinement quotes."""
    w = with_decoded(wide, "c1", "v1")
    w = with_decoded(w, "c2", "v2")
    w = with_decoded_list(w, "c3", "deduced_preferences")
    flagged = w.select(
        *keep,
        "request_id",
        "v1",
        "v2",
        "deduced_preferences",
        json_truthy(F.col("v1")).alias("ok1"),
        (F.col("v2").isNotNull() & json_truthy(F.col("v2"))).alias("ok2"),
    )
    default = F.parse_json(F.lit(DEFAULT_INTENT_JSON))
    initial = F.when(F.col("ok1"), F.col("v1")).otherwise(default)
    return flagged.select(
        *keep,
        "request_id",
        initial.alias("initial"),
        F.when(F.col("ok2"), F.col("v2")).otherwise(initial).alias("intent"),
        F.when(F.col("ok2"), F.lit("refined"))
        .when(F.col("ok1"), F.lit("initial"))
        .otherwise(F.lit("default"))
        .alias("source"),
        "deduced_preferences",
    )


def resolve_intents(responses: DataFrame) -> DataFrame:
    """``request_id, intent (variant), source, deduced_preferences`` with
    source ``refined``, ``initial`` or ``default``."""
    return resolved(steps_wide(responses)).drop("initial")


def _text_or_empty(v: Column) -> Column:
    """``(value or '')`` for a text field: NULL when not text (crash case)."""
    k = jx.kind(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(""))
        .when(k == "STRING", F.try_variant_get(v, "$", "string"))
        .when(~json_truthy(v), F.lit(""))
    )


def typed_intents(
    df: DataFrame, intent_col: str, preferences_col: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Typed-intent columns (see ``operators.intent``) from the VARIANT column
    ``intent_col``; ``keep`` columns are carried through."""
    pr = jx.field(F.col(intent_col), "price_range")
    staged = with_price_bounds(
        df.withColumn("_ti_text", F.when(jx.kind(pr) == "STRING", F.try_variant_get(pr, "$", "string"))),
        "_ti_text",
        "_ti_text_budget",
    )
    prefs = F.col(preferences_col) if preferences_col else None
    return staged.select(
        *keep, *_typed_columns(F.col(intent_col), F.col("_ti_text_budget"), prefs)
    )


def _typed_columns(v: Column, text_budget: Column, preferences: Column | None) -> list[Column]:
    is_obj = jx.kind(v).startswith("OBJECT")
    cat_v = jx.field(v, "category")
    category = F.when(cat_v.isNull(), F.lit("general")).otherwise(
        F.when(jx.kind(cat_v) == "STRING", F.try_variant_get(cat_v, "$", "string"))
    )
    pr = jx.field(v, "price_range")
    pk = jx.kind(pr)
    open_range = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    budget = (
        F.when(pk == "STRING", text_budget)
        .when(pk.startswith("OBJECT"), price_bounds_object(pr))
        .when(~json_truthy(pr), open_range)
    )
    prox_v = jx.field(v, "proximity_km")
    prox = F.when(
        jx.is_number_kind(jx.kind(prox_v)) | (jx.kind(prox_v) == "BOOLEAN"),
        F.try_variant_get(prox_v, "$", "double"),
    )
    mr_v = jx.field(v, "min_rating")
    mr_k = jx.kind(mr_v)
    min_rating = F.when(
        json_truthy(mr_v),
        F.when(jx.is_number_kind(mr_k) | (mr_k == "BOOLEAN"), F.try_variant_get(mr_v, "$", "double"))
        .when(mr_k == "STRING", py_float(F.try_variant_get(mr_v, "$", "string"))),
    )
    ei_v = jx.field(v, "exact_items")
    ei_arr = F.try_variant_get(ei_v, "$", "array<variant>")
    ei_texts = F.transform(ei_arr, lambda e: F.when(jx.kind(e) == "STRING", F.try_variant_get(e, "$", "string")))
    ei_ok = (~json_truthy(ei_v)) | (
        ei_arr.isNotNull() & F.forall(ei_texts, lambda t: t.isNotNull())
    )
    exact_items = F.when(json_truthy(ei_v) & ei_arr.isNotNull(), ei_texts)
    sp = jx.field(v, "specifics")
    # Absent specifics act as {}; a JSON null or a non-object is unusable.
    sp_bad_shape = sp.isNotNull() & (F.is_variant_null(sp) | ~jx.kind(sp).startswith("OBJECT"))
    spec_fields = {
        name: _text_or_empty(jx.field(sp, name))
        for name in ("recipient", "cuisine", "atmosphere", "participants", "type")
    }
    specifics = F.struct(
        *[c.alias(n) for n, c in spec_fields.items() if n != "type"],
        json_truthy(jx.field(sp, "solo")).alias("solo"),
        spec_fields["type"].alias("type"),
    )
    needs_specifics = category.isin("food", "activities", "gifts")
    spec_bad = F.lit(False)
    for c in spec_fields.values():
        spec_bad = spec_bad | c.isNull()
    status = (
        F.when(v.isNull() | ~is_obj, F.lit("invalid_intent"))
        .when(category.isNull(), F.lit("invalid_category"))
        .when(budget.isNull(), F.lit("invalid_price_range"))
        .when(needs_specifics & (sp_bad_shape | spec_bad), F.lit("invalid_specifics"))
        .when(~ei_ok, F.lit("invalid_exact_items"))
        .otherwise(F.lit(OK))
    )
    prefs = preferences if preferences is not None else F.array().cast("array<string>")
    return [
        category.alias("category"),
        budget.alias("budget"),
        prox.alias("proximity_km"),
        min_rating.alias("min_rating"),
        exact_items.alias("exact_items"),
        specifics.alias("specifics"),
        json_truthy(jx.field(v, "is_generic")).alias("is_generic"),
        json_truthy(jx.field(v, "is_ambiguous")).alias("is_ambiguous"),
        F.coalesce(
            F.when(jx.kind(jx.field(v, "confidence")) == "STRING",
                   F.try_variant_get(jx.field(v, "confidence"), "$", "string")),
            F.when(jx.field(v, "confidence").isNull(), F.lit("medium")),
        ).alias("confidence"),
        prefs.alias("preferences"),
        status.alias("intent_status"),
    ]
