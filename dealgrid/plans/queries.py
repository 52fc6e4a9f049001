"""Driver queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the ``fx_*`` relations derived from the driver tables
(``sources.fixtures``). Every query runs over the whole tables. Output
columns are flat, explicitly typed (ids / ranks / counts BIGINT) and, for
floating results, rounded to 6 digits so that the DuckDB oracle in
``plans.oracle`` can be compared value for value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.functions.pricing import with_price_bounds
from dealgrid.functions.text import fmt_fixed, py_float_repr
from dealgrid.operators import cycle, decode, exposure, geojoin, render
from dealgrid.operators.catalog import build_catalog, flatten_items, match_merchants
from dealgrid.operators.intent import OK, fixture_intents, r1_flag
from dealgrid.operators.match import Ranking, rank_keys, top_merchants, with_ask_id
from dealgrid.operators.requests import CUSTOMER_NOT_FOUND, request_asks
from dealgrid.operators.textjoin import contains_pairs, sets_fully_contained
from dealgrid.plans.positions import with_positions
from dealgrid.plans.sizing import materialize, relation_bytes, work_dir
from dealgrid.plans.skew import dictionary_limit, meet, split_hot_join, spread_join
from dealgrid.sources import convlog, csvlog, fixtures, jsonl
from dealgrid.streaming.exposure_stream import run_exposure_stream

# Digits kept for floating outputs and for ranking in oracle-checked queries
# (Spark and DuckDB math differ by ~1e-14 in the last bits).
DIGITS = 6
# Far more than distances equal after rounding differ by, and than the rounding of chords.
NEAREST_MARGIN_KM = 1e-3
# The intent used by the flagship query: food within 30 km, any budget.
FOOD_NEARBY_INTENT = 0


def _catalog(fx: dict[str, DataFrame]) -> DataFrame:
    return build_catalog(fx["fx_merchants"], fx["fx_items"])


def _picked_catalog(fx: dict[str, DataFrame], ranked: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the catalog rows of the merchants among the picks, written. Where the
    picks are few (a key has at most k), the items of other merchants are not grouped."""
    picked = materialize(ranked.select("merchant_id").distinct(), "picked")
    tables = [fx["fx_merchants"], fx["fx_items"]]
    if relation_bytes(picked) <= dictionary_limit(picked.sparkSession):
        tables = [t.join(F.broadcast(picked), "merchant_id", "left_semi") for t in tables]
    return materialize(build_catalog(*tables).select(*columns), "catalog")


def _intents(fx: dict[str, DataFrame]) -> DataFrame:
    # A fixed 27-row literal table: its size bound is proven, broadcast is safe.
    return F.broadcast(fixture_intents(fx["fx_intents"]))


def fixture_requests(fx: dict[str, DataFrame]) -> DataFrame:
    """Every request with its typed intent."""
    return fx["fx_requests"].join(_intents(fx), "intent_id")


def _offers_out(offers: DataFrame) -> DataFrame:
    return offers.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("merchant_id").cast("bigint").alias("merchant_id"),
        F.round("dist_km", DIGITS).alias("dist_km"),
        F.round("score", DIGITS).alias("score"),
    )


def match_all_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 merchants for every request, every rule of the scorer."""
    fx = fixtures.relations(spark, sf_dir)
    asks = request_asks(fixture_requests(fx), fx["fx_customers"])
    offers = top_merchants(asks, match_merchants(fx["fx_merchants"]), score_digits=DIGITS, items=fx["fx_items"])
    return _offers_out(offers)


def match_food_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: for every customer, the best 10 food merchants within 30 km."""
    fx = fixtures.relations(spark, sf_dir)
    requests = (
        fx["fx_customers"]
        .select(
            F.col("consumer_id").alias("request_id"),
            F.col("consumer_id").alias("customer_id"),
            F.lit(FOOD_NEARBY_INTENT).alias("intent_id"),
        )
        .join(_intents(fx), "intent_id")
    )
    asks = request_asks(requests, fx["fx_customers"])
    offers = top_merchants(asks, match_merchants(fx["fx_merchants"]), score_digits=DIGITS, items=fx["fx_items"])
    return _offers_out(offers)



def nearby_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer, standing at coordinates of their own, the merchants within
    their radius: how many, and the nearest (L1, F2, J2 for free points)."""
    fx = fixtures.relations(spark, sf_dir)
    cid = F.col("consumer_id")
    points = fx["fx_customers"].select(
        cid.alias("customer_id"),
        (F.lit(1.2) + (cid * 37 % 1009) / 4000.0).alias("plat"),
        (F.lit(103.6) + (cid * 91 % 1013) / 2500.0).alias("plon"),
        (F.lit(0.5) + cid % 7).cast("double").alias("radius_km"),
    )
    places = fx["fx_merchants"].select("merchant_id", "lat", "lon")
    near = geojoin.within_radius(points, places, "merchant_id")
    # a count and a least number are kept in place (a hash aggregate); a least struct would
    # have every pair sorted by customer, on disk
    found = materialize(
        near.groupBy("customer_id", "plat", "plon", "radius_km").agg(
            F.count(F.lit(1)).alias("n_near"), F.min("chord2").alias("least")
        ),
        "near_counts",
    )
    # the nearest by rounded distance is at most a hair farther than the least chord
    reach = geojoin.chord_km(F.col("least")) + NEAREST_MARGIN_KM
    circles = found.withColumn("radius_km", F.least("radius_km", reach)).drop("least")
    order = F.struct(F.round("dist_km", DIGITS).alias("km"), "merchant_id")
    nearest = geojoin.within_radius(circles, places, "merchant_id")
    nearest = nearest.groupBy("customer_id", "n_near").agg(F.min(order).alias("nearest"))
    return nearest.select(
        F.col("customer_id").cast("bigint").alias("customer_id"),
        "n_near",
        F.col("nearest.merchant_id").cast("bigint").alias("nearest_id"),
        F.col("nearest.km").alias("nearest_km"),
    )


def price_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget bounds of every request's price text (F3); an open upper bound
    is reported as ``has_upper = false`` with a NULL ``price_hi``."""
    fx = fixtures.relations(spark, sf_dir)
    b = F.col("budget")
    inf = float("inf")
    # each distinct text is parsed once
    parsed = with_price_bounds(fx["fx_intents"].select("intent_id", "price_range"), "price_range")
    r = fx["fx_requests"].join(F.broadcast(parsed), "intent_id")
    return (
        r.select(
            F.col("request_id").cast("bigint").alias("request_id"),
            b["lo"].alias("price_lo"),
            F.when(b["hi"] != inf, b["hi"]).alias("price_hi"),
            (b["hi"] != inf).alias("has_upper"),
        )
    )


def _lower_terms(c):
    return F.array_sort(F.array_distinct(F.transform(c, F.lower)))


def match_exact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request that names items: how many merchants carry every named
    item (case-insensitive substring of an item name), via the J5 term x
    item-name containment join."""
    fx = fixtures.relations(spark, sf_dir)
    reqs = fixture_requests(fx).filter(F.size("exact_items") > 0).select(
        "request_id", _lower_terms(F.col("exact_items")).alias("terms")
    )
    names = fx["fx_items"].select(
        "merchant_id", F.lower(F.coalesce("name", F.lit(""))).alias("iname")
    )
    full = (
        sets_fully_contained(reqs.select("terms").distinct(), "terms", names, "merchant_id", "iname")
        .groupBy("terms")
        .agg(F.count(F.lit(1)).alias("n_merchants"))
    )
    return spread_join(reqs, full, ["terms"], ["request_id"], "left").select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.coalesce("n_merchants", F.lit(0)).cast("bigint").alias("n_merchants"),
    )


def match_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request with the preference boost active (generic, ambiguous or
    low confidence; preferences given; no exact items): how many merchants
    have a preference inside their category or primary category (C12)."""
    fx = fixtures.relations(spark, sf_dir)
    r = fixture_requests(fx)
    boost = (
        r1_flag(F.col("is_generic"), F.col("is_ambiguous"), F.col("confidence"))
        & (F.size("preferences") > 0)
        & ~F.coalesce(F.size("exact_items") > 0, F.lit(False))
    )
    reqs = r.filter(boost).select(
        "request_id", F.array_sort(F.array_distinct("preferences")).alias("prefs")
    )
    set_terms = reqs.select("prefs").distinct().select("prefs", F.explode("prefs").alias("pref"))
    catalog = fx["fx_merchants"].select(
        F.lower(F.coalesce("category", F.lit(""))).alias("mc"),
        F.lower(F.coalesce("primary_category", F.lit(""))).alias("pc"),
    )
    pair_counts = catalog.groupBy("mc", "pc").agg(F.count(F.lit(1)).alias("n"))
    pair_texts = pair_counts.select(
        "mc", "pc", "n", F.explode(F.array_distinct(F.array("mc", "pc"))).alias("text")
    )
    hits = contains_pairs(set_terms, "pref", pair_texts, "text")
    set_texts = set_terms.join(hits, "pref").select("prefs", "text").distinct()
    per_pair = pair_texts.join(set_texts, "text").select("prefs", "mc", "pc", "n").distinct()
    per_set = per_pair.groupBy("prefs").agg(F.sum("n").alias("n_boosted"))
    return spread_join(reqs, per_set, ["prefs"], ["request_id"], "left").select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.coalesce("n_boosted", F.lit(0)).cast("bigint").alias("n_boosted"),
    )


def _with_items(fx: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``fx`` with the items written once, for queries whose catalog and ranking read them."""
    return {**fx, "fx_items": materialize(fx["fx_items"], "items")}


def _outcomes(
    fx: dict[str, DataFrame], keep: tuple[str, ...] = (), items_written: bool = False
) -> tuple[DataFrame, Ranking]:
    """Requests (``request_id, customer_id, status, ask_id`` and ``keep``) and the
    ranking."""
    requests = fixture_requests(fx)
    if keep:
        extra = fx["fx_intents"].select("intent_id", *[c for c in keep if c not in requests.columns])
        requests = requests.join(F.broadcast(extra), "intent_id")
    asks = request_asks(requests, fx["fx_customers"], keep=keep)
    ranking = rank_keys(
        asks, match_merchants(fx["fx_merchants"]), score_digits=DIGITS, items=fx["fx_items"],
        items_written=items_written,
    )
    return with_ask_id(asks), ranking


def _status(n):
    return (
        F.when(F.col("status") != OK, F.col("status"))
        .when(n == 0, F.lit("no_match"))
        .otherwise(F.lit("matched"))
    )


def _with_responses(fx: dict[str, DataFrame], df: DataFrame) -> DataFrame:
    """``df`` with the last call's ``content`` and ``error`` (one row a request)."""
    return df.join(fx["fx_offer_responses"], "request_id", "left")


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request: outcome status, number of offers, best merchant, the offer text
    or its fallback (J1, O4), and the intent in force (none for an unknown
    customer)."""
    fx = fixtures.relations(spark, sf_dir)
    asks, ranking = _outcomes(fx, keep=("category", "confidence"))
    per_key = ranking.ranked.groupBy("ask_id").agg(
        F.count(F.lit(1)).alias("n_offers"),
        F.min_by("merchant_id", "rank").alias("top_merchant_id"),
    )
    j = _with_responses(fx, ranking.fan_out(asks, per_key, "left"))
    n = F.coalesce("n_offers", F.lit(0))
    known = F.col("status") != CUSTOMER_NOT_FOUND
    return j.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        _status(n).alias("status"),
        n.cast("bigint").alias("n_offers"),
        F.col("top_merchant_id").cast("bigint").alias("top_merchant_id"),
        render.offer_text(F.col("status"), n, F.col("content"), F.col("error")).alias("offer_text"),
        F.when(known, F.col("category")).alias("category"),
        F.when(known, F.col("confidence")).alias("confidence"),
    )


def match_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request path from model text: responses decoded, refined or
    defaulted (F12, O1, O2), typed with quarantine (§7.4), preferences from
    step 3 when present (F13, O3), then matched and ranked (J1-J3, W1)."""
    fx = fixtures.relations(spark, sf_dir)
    resolved = decode.resolve_intents(fx["fx_responses"])
    typed = decode.typed_intents(
        resolved, "intent", "deduced_preferences", keep=("request_id",)
    )
    requests = fx["fx_requests"].select("request_id", "customer_id").join(
        typed, "request_id"
    )
    # read twice, by the key dictionary and the fan-out: decoded once
    asks = materialize(request_asks(requests, fx["fx_customers"]), "request_asks")
    return _offers_out(top_merchants(asks, match_merchants(fx["fx_merchants"]), score_digits=DIGITS, items=fx["fx_items"]))


def unknown_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose customer id is not in the customer table (anti-join)."""
    fx = fixtures.relations(spark, sf_dir)
    cust = fx["fx_customers"].select(F.col("consumer_id").alias("customer_id"))
    requests = fx["fx_requests"]
    return split_hot_join(
        requests, cust, "customer_id", "customer_id", ["request_id"], "left_anti"
    ).select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("customer_id").cast("bigint").alias("customer_id"),
    )


def exposure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each merchant id was recommended, over the whole log (A1)."""
    fx = fixtures.relations(spark, sf_dir)
    return exposure.exposure_counts(fx["fx_log"])


def exposure_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure counts with merchant details, unknown ids labelled."""
    fx = fixtures.relations(spark, sf_dir)
    counts = exposure.exposure_counts(fx["fx_log"])
    return exposure.leaderboard(counts, fx["fx_merchants"])


def leaderboard_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard with the place of each merchant, 1..n without gaps, numbered by
    ranges instead of in one task (W2, W3)."""
    order = [F.desc("exposure"), "key_kind", "merchant_key"]
    placed = with_positions(exposure_leaderboard(spark, sf_dir), order)
    return placed.withColumn("place", F.col("position") + 1).drop("position")


def distinct_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduced preferences as a set, only for generic / ambiguous /
    low-confidence requests (A2, O3)."""
    fx = fixtures.relations(spark, sf_dir)
    r = fixture_requests(fx).filter(
        r1_flag(F.col("is_generic"), F.col("is_ambiguous"), F.col("confidence"))
    )
    return r.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.explode(F.array_distinct("preferences")).alias("preference"),
    )


def _text_field(v, name: str):
    f = F.variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(f, "$", "string"))


def intent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model response decoded (F12): how it decoded and the category
    and confidence it carries."""
    fx = fixtures.relations(spark, sf_dir)
    d = decode.with_decoded(fx["fx_responses"], "content", "v")
    return d.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("step").cast("bigint").alias("step"),
        F.col("v_how").alias("how"),
        _text_field(F.col("v"), "category").alias("category"),
        _text_field(F.col("v"), "confidence").alias("confidence"),
    )


def intent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request what became of its responses (F4, F12, F13, O1-O3, §7.4): the
    intent's status (usable, or why it is quarantined), its budget, radius, rating and
    number of exact items, and the deduced preferences."""
    fx = fixtures.relations(spark, sf_dir)
    typed = decode.typed_intents(
        decode.resolve_intents(fx["fx_responses"]), "intent", "deduced_preferences",
        keep=("request_id", "source"),
    )
    inf = float("inf")
    ok = F.col("intent_status") == OK
    return typed.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        "source",
        "intent_status",
        F.when(ok, F.col("budget.lo")).alias("price_lo"),
        F.when(ok & (F.col("budget.hi") != inf), F.col("budget.hi")).alias("price_hi"),
        F.when(ok, F.col("proximity_km")).alias("proximity_km"),
        F.when(ok, F.col("min_rating")).alias("min_rating"),
        F.when(ok, F.coalesce(F.size("exact_items"), F.lit(0))).cast("bigint").alias("n_items"),
        F.array_join("preferences", "|").alias("preferences"),
    )


def intent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request the intent in force after extraction, default and
    refinement (O1, O2)."""
    fx = fixtures.relations(spark, sf_dir)
    res = decode.resolve_intents(fx["fx_responses"])
    return res.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        "source",
        _text_field(F.col("intent"), "category").alias("category"),
        _text_field(F.col("intent"), "confidence").alias("confidence"),
    )


def customer_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer picker labels."""
    fx = fixtures.relations(spark, sf_dir)
    c = fx["fx_customers"]
    return c.select(
        F.col("consumer_id").cast("bigint").alias("customer_id"),
        render.customer_label(
            F.col("consumer_id"), F.col("name"), F.col("age"), F.col("sex"),
            F.col("district"), F.col("balance"),
        ).alias("label"),
    )


def _transactions(fx: dict[str, DataFrame]) -> DataFrame:
    return fx["fx_transactions"].groupBy("consumer_id").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "merchant_id", "category", "amount"))
        ).alias("transactions")
    )


def recent_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the recent transactions as tuple text, in order."""
    fx = fixtures.relations(spark, sf_dir)
    c = fx["fx_customers"].select("consumer_id").join(
        _transactions(fx), "consumer_id", "left"
    )
    return c.select(
        F.col("consumer_id").cast("bigint").alias("customer_id"),
        F.coalesce(F.size("transactions"), F.lit(0)).cast("bigint").alias("n_transactions"),
        render.transactions_text(F.col("transactions")).alias("transactions_text"),
    )


def offer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item lines of every offered merchant (P4): first 3 items by
    position, items without a price skipped. Rendered once per (match key,
    merchant), then fanned out to the requests sharing the key."""
    fx = fixtures.relations(spark, sf_dir)
    fx = _with_items(fx)
    asks, ranking = _outcomes(fx, items_written=True)
    catalog = _picked_catalog(fx, ranking.ranked, ("merchant_id", "top_items"))
    # a merchant may be among the picks of very many keys, or the picks fewer than the merchants
    picked = meet(ranking.ranked, catalog, ["merchant_id"], ["ask_id"], ["merchant_id"])
    lines = picked.select(
        "ask_id", "rank", F.explode(render.item_lines(F.col("top_items"))).alias("it")
    )
    return ranking.fan_out(asks, lines).select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("it.pos").cast("bigint").alias("item_pos"),
        F.col("it.name").alias("item_name"),
        F.round("it.price", DIGITS).alias("price"),
        F.round("it.discount_percent", DIGITS).alias("discount_percent"),
        F.round("it.discounted", DIGITS).alias("discounted_price"),
    )


def offer_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched-merchant listing per request (P5, W2): rank, label, id and the
    distance to one decimal when known."""
    fx = fixtures.relations(spark, sf_dir)
    asks, ranking = _outcomes(fx)
    names = fx["fx_merchants"].select("merchant_id", "name")
    lines = meet(ranking.ranked, names, ["merchant_id"], ["ask_id"], ["merchant_id"]).select(
        "ask_id",
        "rank",
        "merchant_id",
        render.listing_label(F.col("rank"), F.col("name"), F.col("merchant_id")).alias("label"),
        fmt_fixed(F.col("dist_km"), 1).alias("distance_km"),
    )
    return ranking.fan_out(asks, lines).select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("merchant_id").cast("bigint").alias("merchant_id"),
        "label",
        "distance_km",
    )


SUMMARY_COLUMNS = ("merchant_id", "name", "primary_category", "rating", "top_items")


def _offer_summaries(catalog: DataFrame, ranked: DataFrame) -> DataFrame:
    """``ask_id, summary``: the merchant blocks of a key in rank order (P4),
    rendered once per key (at most k blocks each)."""
    cat = catalog.select(*SUMMARY_COLUMNS)
    blocks = meet(ranked, cat, ["merchant_id"], ["ask_id"], ["merchant_id"]).select(
        "ask_id",
        "rank",
        render.merchant_block(
            F.col("name"), F.col("primary_category"), py_float_repr(F.col("rating")),
            F.col("dist_km"), F.col("top_items"),
        ).alias("block"),
    )
    return blocks.groupBy("ask_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]),
            "\n",
        ).alias("summary")
    )


# Log time given to the rows a batch appends, so that the union queries are
# reproducible; the library default is the current time.
BATCH_LOG_TIME = "2024-06-01T00:00:00"
INTENT_COLUMNS = (
    "category", "price_range", "proximity_km", "min_rating", "exact_items", "recipient", "cuisine",
    "atmosphere", "participants", "solo", "activity_type", "is_generic", "is_ambiguous", "confidence",
)


def _intent_struct():
    """The flat fixture intent in the nested shape of a decoded one."""
    items = F.when(F.col("exact_items").isNotNull(), F.split("exact_items", r"\|"))
    names = ("recipient", "cuisine", "atmosphere", "participants", "solo")
    return F.struct(
        "category",
        items.alias("exact_items"),
        "price_range",
        "proximity_km",
        "min_rating",
        F.struct(*names, F.col("activity_type").alias("type")).alias("specifics"),
        "is_generic",
        "is_ambiguous",
        "confidence",
    )


def _flat_requests(fx: dict[str, DataFrame]) -> DataFrame:
    """Requests with their flat intent columns and request text."""
    r = fx["fx_requests"].join(F.broadcast(fx["fx_intents"]), "intent_id")
    return r.withColumn("user_request", _request_text())


def _batch_log_rows(fx: dict[str, DataFrame]) -> DataFrame:
    """The log rows of the fixture requests (P10): time, customer, request text, intent
    in force as JSON, offer text, recommended ids."""
    asks, ranking = _outcomes(fx)
    per_key = ranking.ranked.groupBy("ask_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "merchant_id"))).alias("picks")
    )
    j = _with_responses(fx, ranking.fan_out(asks, per_key, "left")).join(
        _flat_requests(fx).select(
            "request_id", "user_request",
            F.to_json(_intent_struct(), {"ignoreNullFields": "false"}).alias("intent"),
        ),
        "request_id",
    )
    ids = F.coalesce(
        F.transform(F.col("picks"), lambda p: p["merchant_id"]), F.array().cast("array<bigint>")
    )
    known = F.col("status") != CUSTOMER_NOT_FOUND
    return j.select(
        F.lit(BATCH_LOG_TIME).alias("timestamp"),
        F.col("customer_id").cast("string").alias("customer_id"),
        "user_request",
        F.when(known, F.col("intent")).otherwise(F.lit("{}")).alias("intent"),
        render.offer_text(
            F.col("status"), F.size(ids), F.col("content"), F.col("error")
        ).alias("offer"),
        render.ids_json(ids).alias("recommended_merchants"),
    )


def _history_rows(fx: dict[str, DataFrame], with_ids: bool = True) -> DataFrame:
    cols = [
        render.log_time(F.col("ts")).alias("timestamp"),
        F.col("customer_id").cast("string").alias("customer_id"),
    ]
    if with_ids:
        cols.append(F.col("recommended_merchants"))
    return fx["fx_log"].select(*cols)


def _log_out(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("timestamp").alias("log_time"),
        F.col("customer_id").cast("bigint").alias("customer_id"),
        *[
            F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
            for c in ("user_request", "intent", "offer")
        ],
        "recommended_merchants",
    )


def log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History plus the rows this batch of requests appends."""
    fx = fixtures.relations(spark, sf_dir)
    return _log_out(convlog.union_logs(_history_rows(fx), _batch_log_rows(fx)))


def log_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old log without the id column, backfilled with '[]', plus the
    batch rows (S9, U1)."""
    fx = fixtures.relations(spark, sf_dir)
    old = _history_rows(fx, with_ids=False)
    return _log_out(convlog.union_logs(old, _batch_log_rows(fx)))


def log_append_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log folder on disk: files written before the log had the id column, appended
    rows with ids (NULL ones too), and this batch's rows; read back as history (S8-S10,
    P10, U1)."""
    fx = fixtures.relations(spark, sf_dir)
    path = f"{work_dir(spark, 'log')}/conversations"
    log = fx["fx_log"]
    old = {**fx, "fx_log": log.filter("log_id % 2 = 0")}
    new = {**fx, "fx_log": log.filter("log_id % 2 = 1")}
    _history_rows(old, with_ids=False).write.parquet(path)
    convlog.append(_history_rows(new), path)
    convlog.append(_batch_log_rows(fx), path)
    return _log_out(convlog.history(spark, path))


def log_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the log folder before clearing, after clearing, and after the next
    append; and of a folder that was never written (S2, S8, S10, S11)."""
    fx = fixtures.relations(spark, sf_dir)
    path = f"{work_dir(spark, 'log')}/conversations"

    def rows(step: str, where: str) -> DataFrame:
        n = convlog.history(spark, where).agg(F.count(F.lit(1)).alias("n_rows"))
        return materialize(n.select(F.lit(step).alias("step"), "n_rows"), "log_size")

    out = rows("never written", f"{path}-missing")
    convlog.append(_history_rows(fx), path)
    out = out.unionByName(rows("appended", path))
    convlog.clear(spark, path)
    out = out.unionByName(rows("cleared", path))
    convlog.append(_history_rows({**fx, "fx_log": fx["fx_log"].filter("log_id % 3 = 0")}), path)
    return out.unionByName(rows("appended again", path))


def _csv_log_rows(fx: dict[str, DataFrame]) -> DataFrame:
    """The fixture log with texts that need CSV quoting: quotes, commas, line ends, blanks."""
    n = F.col("log_id").cast("string")
    request = (
        F.when(F.col("log_id") % 4 == 0, F.lit(None).cast("string"))
        .when(F.col("log_id") % 4 == 1, F.concat(F.lit("plain "), n))
        .when(F.col("log_id") % 4 == 2, F.concat(F.lit('He said "'), n, F.lit('", twice')))
        .otherwise(F.concat(F.lit('one\n\n"'), n, F.lit('",\ntwo ')))
    )
    return fx["fx_log"].select(
        "log_id",
        render.log_time(F.col("ts")).alias("timestamp"),
        F.col("customer_id").cast("string").alias("customer_id"),
        request.alias("user_request"),
        F.concat(F.lit('{"id": '), n, F.lit(',\n "q": "a, b"}')).alias("intent"),
        F.when(F.col("log_id") % 5 == 0, F.lit("")).otherwise(F.lit("offer")).alias("offer"),
        "recommended_merchants",
    )


def log_csv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as CSV files, half of them older ones with other columns, read back in
    splits: records over several lines, headers of their own, NULL and empty text apart
    (S8-S10)."""
    fx = fixtures.relations(spark, sf_dir)
    base = work_dir(spark, "csvlog")
    rows = _csv_log_rows(fx)
    old = rows.filter("log_id % 2 = 0")
    convlog.export_csv(old.select("intent", "customer_id", "timestamp", "user_request"), f"{base}/old")
    convlog.export_csv(rows.filter("log_id % 2 = 1").select(*convlog.LOG_COLUMNS), f"{base}/new")
    return _log_out(csvlog.history(spark, [f"{base}/old", f"{base}/new"]))


def _request_text():
    """Fixture requests carry no typed text; a short text is derived from the
    intent so the prompts have something to quote."""
    return F.concat_ws(
        " ",
        F.coalesce("category", F.lit("anything")),
        F.coalesce("price_range", F.lit("")),
        F.when(F.col("proximity_km").isNotNull(),
               F.concat(F.lit("within "), F.col("proximity_km").cast("string"), F.lit(" km"))),
    )


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch-inference input: one prompt row per request and step (P2, P6-P9):
    extraction, refinement, preferences for generic requests, and the offer
    prompt with the request text and merchant summary for requests that matched."""
    fx = fixtures.relations(spark, sf_dir)
    cust = fx["fx_customers"].join(_transactions(fx), "consumer_id", "left")
    j = split_hot_join(_flat_requests(fx), cust, "customer_id", "consumer_id", ["request_id"])
    text = F.col("user_request")
    intent_json = render.pretty_json(_intent_struct())
    profile = render.profile_text()
    r1 = r1_flag(F.col("is_generic"), F.col("is_ambiguous"), F.col("confidence"))
    steps = F.array(
        F.struct(F.lit(1).alias("step"), render.extract_prompt(text).alias("text")),
        F.struct(F.lit(2).alias("step"), render.refine_prompt(text, intent_json, profile).alias("text")),
        F.struct(F.lit(3).alias("step"),
                 F.when(r1, render.preference_prompt(F.col("category"), profile)).alias("text")),
    )
    first_three = j.select("request_id", F.explode(steps).alias("p")).filter(
        F.col("p.text").isNotNull()
    )
    fx = _with_items(fx)
    asks, ranking = _outcomes(fx, items_written=True)
    catalog = _picked_catalog(fx, ranking.ranked, SUMMARY_COLUMNS)
    summaries = ranking.fan_out(asks, _offer_summaries(catalog, ranking.ranked)).select(
        "request_id", "summary"
    )
    offer = j.join(summaries, "request_id").select(
        "request_id",
        F.struct(
            F.lit(4).alias("step"),
            render.offer_prompt(
                render.profile_text(with_amounts=False), intent_json, F.col("summary"), text
            ).alias("text"),
        ).alias("p"),
    )
    return first_three.unionByName(offer).select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("p.step").cast("bigint").alias("step"),
        F.col("p.text").alias("text"),
    )


def _response_summaries(fx: dict[str, DataFrame], responses: DataFrame) -> DataFrame:
    """``request_id, summary`` of the requests that match by their decoded intents."""
    typed = decode.typed_intents(
        decode.resolve_intents(responses), "intent", "deduced_preferences", keep=("request_id",)
    )
    requests = fx["fx_requests"].select("request_id", "customer_id").join(typed, "request_id")
    asks = materialize(request_asks(requests, fx["fx_customers"]), "request_asks")
    fx = _with_items(fx)
    ranking = rank_keys(
        asks, match_merchants(fx["fx_merchants"]), score_digits=DIGITS, items=fx["fx_items"], items_written=True
    )
    catalog = _picked_catalog(fx, ranking.ranked, SUMMARY_COLUMNS)
    lines = _offer_summaries(catalog, ranking.ranked)
    return ranking.fan_out(with_ask_id(asks), lines).select("request_id", "summary")


def request_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts due in each of four inference rounds (O1-O4, P6-P9): each round sees the
    answers to the rounds before, those of every seventh request a round late; refinement
    quotes the decoded first reading, the offer prompt the intent in force, and merchants are
    matched by it."""
    fx = fixtures.relations(spark, sf_dir)
    cust = fx["fx_customers"].join(_transactions(fx), "consumer_id", "left")
    j = split_hot_join(_flat_requests(fx), cust, "customer_id", "consumer_id", ["request_id"])
    requests = materialize(
        j.select(
            "request_id",
            "user_request",
            render.profile_text().alias("profile"),
            render.profile_text(with_amounts=False).alias("offer_profile"),
        ),
        "cycle_requests",
    )
    responses = materialize(fx["fx_responses"], "cycle_responses")
    late = F.when(F.col("request_id") % 7 == 3, 1).otherwise(0)
    last = 4
    offers = _response_summaries(fx, responses.filter(F.col("step") < last - late))
    # a request of a round is a request of its own, so that one plan serves all rounds
    own = F.struct("round", "request_id").alias("request_id")
    rounds = F.explode(F.sequence(F.lit(1), F.lit(last))).alias("round")
    seen = responses.withColumn("late", late).select("*", rounds).filter("step < round - late")
    due = cycle.due_prompts(
        requests.select("*", rounds).select(own, "user_request", "profile", "offer_profile"),
        seen.select(own, "step", "content"),
        offers.withColumn("round", F.lit(last)).select(own, "summary"),
    )
    return due.select(
        F.col("request_id.round").cast("bigint").alias("round"),
        F.col("request_id.request_id").cast("bigint").alias("request_id"),
        F.col("step").cast("bigint").alias("step"),
        "text",
    )


def _merchant_json_lines(fx: dict[str, DataFrame]) -> DataFrame:
    items = fx["fx_items"].groupBy("merchant_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "price", "discount_percent"))).alias("its")
    )
    m = fx["fx_merchants"].join(items, "merchant_id", "left")
    record = F.struct(
        "merchant_id", "name", "category", "primary_category", "rating", "lat", "lon",
        F.struct(F.col("district")).alias("address"),
        F.transform(
            F.coalesce("its", F.array()),
            lambda it: F.struct(it["name"].alias("name"), it["price"].alias("price"),
                                it["discount_percent"].alias("discount_percent")),
        ).alias("items"),
    )
    return m.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def jsonl_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants written as JSON lines (a stale copy of every record, junk
    lines, then the current copy), read back with the keyed last-wins loader
    and typed with the absent/null defaults (S1-S6)."""
    fx = fixtures.relations(spark, sf_dir)
    base = work_dir(spark, "jsonl")
    current = _merchant_json_lines(fx)
    stale = fx["fx_merchants"].select(
        F.to_json(F.struct("merchant_id", F.lit("stale").alias("name"))).alias("value")
    )
    junk = fx["fx_merchants"].select(
        F.when(F.col("merchant_id") % 3 == 0, F.lit("{broken"))
        .when(F.col("merchant_id") % 3 == 1, F.lit(""))
        .otherwise(F.lit('{"name": "no key"}')).alias("value")
    )
    stale.union(junk).write.text(f"{base}/a")
    current.write.text(f"{base}/b")
    m = jsonl.merchants(spark, [f"{base}/a", f"{base}/b"])
    n_items = flatten_items(m).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n_items"))
    return m.join(n_items, "merchant_id", "left").select(
        F.col("merchant_id").cast("bigint").alias("merchant_id"),
        "name",
        F.col("rating").alias("rating"),
        F.col("lat").alias("lat"),
        F.col("lon").alias("lon"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
    )


def _raw_merchants(spark: SparkSession, fx: dict[str, DataFrame]) -> DataFrame:
    """Merchant records with absent, null and text fields, written as JSON lines and
    loaded."""
    path = f"{work_dir(spark, 'jsonl')}/merchants"
    fx["fx_merchant_json"].select("value").write.text(path)
    return jsonl.merchants(spark, path)


def offer_items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary header and item lines of every merchant as loaded from JSON lines: absent
    price and discount count as 0, null or non-numeric ones leave the item out, text
    numbers are read, an absent rating or name prints as None (P4)."""
    fx = fixtures.relations(spark, sf_dir)
    m = _raw_merchants(spark, fx)
    catalog = build_catalog(m, flatten_items(m))
    lines = F.transform(render.item_lines(F.col("top_items")), render.item_line_text)
    header = render.merchant_header(
        F.col("name"), F.col("primary_category"), F.col("rating_shown"), F.lit(None).cast("double")
    )
    return catalog.select(
        F.col("merchant_id").cast("bigint").alias("merchant_id"),
        header.alias("header"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.array_join(lines, "\n").alias("lines"),
    )


def leaderboard_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard over merchants as the JSON-lines loader gives them: unknown
    merchants and absent fields are labelled, null fields are NULL (J4, F15)."""
    fx = fixtures.relations(spark, sf_dir)
    counts = exposure.exposure_counts(fx["fx_log"])
    m = _raw_merchants(spark, fx)
    return exposure.leaderboard(counts, build_catalog(m, flatten_items(m)))


def id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose customer id is text, floating or boolean against customers keyed
    by number (F1, J1): which find their customer."""
    fx = fixtures.relations(spark, sf_dir)
    r = fixture_requests(fx).drop("customer_id")
    rid = F.col("request_id")
    as_text = (
        F.when(rid % 5 == 0, rid.cast("string"))
        .when(rid % 5 == 1, F.concat(F.lit(" 0"), rid.cast("string"), F.lit(" ")))
        .when(rid % 5 == 2, F.concat(rid.cast("string"), F.lit(".0")))
        .when(rid % 5 == 3, F.concat(F.lit("12345678901234567"), F.lpad((rid % 1000).cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("c"), rid.cast("string")))
    )
    forms = {"text": as_text, "double": rid + F.lit(0.9), "boolean": rid % 2 == 1}
    out = None
    for form, value in forms.items():
        asks = request_asks(r.withColumn("customer_id", value), fx["fx_customers"])
        rows = asks.select(
            F.col("request_id").cast("bigint").alias("request_id"),
            F.lit(form).alias("form"),
            (F.col("status") != CUSTOMER_NOT_FOUND).alias("found"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def log_id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure counts of ids written as 20-digit numbers, text, floats and booleans:
    equal numbers are one id, long ones stay apart, text is not a number (A1)."""
    fx = fixtures.relations(spark, sf_dir)
    return exposure.exposure_counts(fx["fx_id_log"])


def exposure_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure counts maintained by a streaming job over the log, fed in
    several appends (extension of A1)."""
    fx = fixtures.relations(spark, sf_dir)
    counts, _ = run_exposure_stream(spark, fx["fx_log"])
    return counts


QUERIES = {
    "match_food_nearby": match_food_nearby,
    "match_all_intents": match_all_intents,
    "nearby_merchants": nearby_merchants,
    "price_range_parse": price_range_parse,
    "match_exact_items": match_exact_items,
    "match_preferences": match_preferences,
    "request_outcomes": request_outcomes,
    "unknown_customers": unknown_customers,
    "exposure_counts": exposure_counts,
    "exposure_leaderboard": exposure_leaderboard,
    "leaderboard_ranked": leaderboard_ranked,
    "distinct_preferences": distinct_preferences,
    "intent_decode": intent_decode,
    "intent_resolve": intent_resolve,
    "customer_directory": customer_directory,
    "recent_transactions": recent_transactions,
    "offer_items": offer_items,
    "offer_listing": offer_listing,
    "log_union": log_union,
    "log_backfill": log_backfill,
    "prompt_table": prompt_table,
    "request_cycle": request_cycle,
    "jsonl_ingest_dedupe": jsonl_ingest_dedupe,
    "exposure_stream": exposure_stream,
    "match_from_responses": match_from_responses,
    "intent_status": intent_status,
    "log_append_history": log_append_history,
    "log_clear": log_clear,
    "log_csv_history": log_csv_history,
    "offer_items_raw": offer_items_raw,
    "leaderboard_raw": leaderboard_raw,
    "id_forms": id_forms,
    "log_id_forms": log_id_forms,
}
