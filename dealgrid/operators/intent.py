"""Typed intents and the match key.

A *typed intent* is a set of columns::

    category string, budget struct<lo double, hi double>, proximity_km double,
    min_rating double, exact_items array<string>,
    specifics struct<recipient, cuisine, atmosphere, participants string,
                     solo boolean, type string>,
    is_generic boolean, is_ambiguous boolean, confidence string,
    preferences array<string>, intent_status string

``intent_status`` is ``ok`` or the reason a request is quarantined (it then
gets no offers instead of failing the batch): ``invalid_intent``,
``invalid_category``, ``invalid_price_range``, ``invalid_specifics``,
``invalid_exact_items``.

``ask_key`` folds a typed intent and the customer point into the *match key*:
a struct holding exactly the fields the scorer reads, with the ones that
cannot matter nulled out, so requests with equal keys are ranked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.pricing import with_price_bounds
from dealgrid.functions.text import lower_or_empty

OK = "ok"


def r1_flag(is_generic: Column, is_ambiguous: Column, confidence: Column) -> Column:
    """Generic, ambiguous or low-confidence request (preference boost gate)."""
    return (
        F.coalesce(is_generic, F.lit(False))
        | F.coalesce(is_ambiguous, F.lit(False))
        | F.coalesce(confidence == "low", F.lit(False))
    )


def _split_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), F.split(c, r"\|"))


def fixture_intents(fx_intents: DataFrame) -> DataFrame:
    """``fx_intents`` (flat, `|`-joined lists) -> typed intent columns."""
    return with_price_bounds(fx_intents, "price_range").select(
        "intent_id",
        F.col("category"),
        "budget",
        F.col("proximity_km"),
        F.col("min_rating"),
        _split_or_null(F.col("exact_items")).alias("exact_items"),
        F.struct(
            F.col("recipient"),
            F.col("cuisine"),
            F.col("atmosphere"),
            F.col("participants"),
            F.col("solo"),
            F.col("activity_type").alias("type"),
        ).alias("specifics"),
        "is_generic",
        "is_ambiguous",
        "confidence",
        _split_or_null(F.col("preferences")).alias("preferences"),
        F.when(F.col("category").isNull(), F.lit("invalid_category"))
        .otherwise(F.lit(OK))
        .alias("intent_status"),
    )


def ask_key(point: Column) -> Column:
    """Match key from the typed-intent columns in scope and ``point``
    (``struct<lat, lon>`` of the customer)."""
    cat = F.col("category")
    sp = F.col("specifics")
    food = cat == "food"
    act = cat == "activities"
    gifts = cat == "gifts"
    prox = F.col("proximity_km")
    minr = F.col("min_rating")
    items = F.col("exact_items")
    terms = F.when(
        F.size(items) > 0, F.array_sort(F.array_distinct(F.transform(items, F.lower)))
    )
    prefs = F.col("preferences")
    r1 = r1_flag(F.col("is_generic"), F.col("is_ambiguous"), F.col("confidence"))
    boost = F.when(
        r1 & (F.size(prefs) > 0) & terms.isNull(),
        F.array_sort(F.array_distinct(F.filter(prefs, lambda p: p.isNotNull()))),
    )
    return F.struct(
        cat.alias("cat"),
        F.col("budget.lo").alias("lo"),
        F.col("budget.hi").alias("hi"),
        prox.alias("prox"),
        F.when(minr.isNull() | (minr == 0) | F.isnan(minr), F.lit(None).cast("double"))
        .otherwise(minr)
        .alias("minr"),
        terms.alias("terms"),
        F.when(food, lower_or_empty(sp["cuisine"])).otherwise("").alias("cuisine"),
        F.when(food, lower_or_empty(sp["atmosphere"])).otherwise("").alias("atmos"),
        F.when(act, lower_or_empty(sp["participants"])).otherwise("").alias("partic"),
        F.when(act, F.coalesce(sp["solo"], F.lit(False))).otherwise(False).alias("solo"),
        F.when(act, lower_or_empty(sp["type"])).otherwise("").alias("atype"),
        F.when(gifts, lower_or_empty(sp["recipient"])).otherwise("").alias("recip"),
        boost.alias("prefs"),
        F.when(prox.isNotNull(), point["lat"]).alias("plat"),
        F.when(prox.isNotNull(), point["lon"]).alias("plon"),
    )
