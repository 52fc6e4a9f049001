"""Request x merchant matching, scoring and top-k (SURVEY J3, J5, L1-L7,
C1-C13, R1, W1, W2, §4.2).

Physical design. A direct request x merchant join is a cartesian product. It
factors exactly because a merchant's score depends on a request only through
the *match key* (``intent.ask_key``), its integer part only through the key's
category fields, and on the merchant's category text only through the distinct
``(mc, pc)`` pair:

1. ``keys``: distinct match keys of the requests, each with a compact id
   (``ask_id``, a digest of the key) that all later steps shuffle and rank on,
   the id of its category fields (``cat_id``) and its gazetteer point.
2. ``cats``: distinct category fields; ``pairs``: distinct ``(mc, pc)`` of the
   catalog. Budgets, radii and points do not multiply them.
3. Category candidates ``cats x pairs`` come from an **equi-join on text
   grams**: a pair emits every substring of length <= 3 of ``mc`` and ``pc``
   plus the tokens ``ALL`` and (if a gift keyword is present) ``MOTHER``; the
   category fields emit the first <= 3 characters of the lower-cased category,
   or ``ALL`` for ``general`` / empty category, plus ``MOTHER`` for gifts for a
   mother. Containment implies the gram matches, so the join is a superset; the
   exact rules are then evaluated per (cat, pair) row (C1-C12).
4. Keys that share category fields, point and item terms differ by filters alone
   (budget, radius, rating). They share a *posting list*: the merchants of its category
   pairs with distance and score, best first. Distances from a merchant to the 22 gazetteer
   points are computed once per merchant. Lists with item terms hold the merchants of
   the J5 containment join. Budgets are tested on price cells (``operators.pricecells``).
5. Top-k per key by ``operators.postings``: blocks of its list are read from the top and
   filtered until k merchants passed. Rows read follow keys x k, not keys x merchants.
   Only what a head of each list leaves open is sorted into blocks.
   (Where reading whole lists is counted to be little work, that is done instead.)
6. Requests equi-join the ranked keys on ``ask_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.geo import distances_km, haversine_km, point_index
from dealgrid.functions.text import contains_any, py_max0
from dealgrid.operators import postings, pricecells
from dealgrid.operators.catalog import item_prices
from dealgrid.operators.textjoin import EVERY_TEXT, GRAM, grams, sets_fully_contained
from dealgrid.plans.sizing import materialize
from dealgrid.plans.skew import spread_join

TOP_K = 10

# --- Fixed values (keyword lists and points of the scoring rules) ----------
# Gifts for a mother match merchants whose category text has any of these.
MOTHER_KEYWORDS = (
    "florist", "spa", "jewelry", "chocolates", "books", "fashion",
    "souvenirs", "stationery", "e-gift cards",
)
# Sports activities are penalised unless the category has one of these.
SPORT_KEYWORDS = ("sports", "swimming", "gym", "fitness", "running")
# Couple activities are penalised unless the category has one of these.
COUPLE_KEYWORDS = ("spa", "romantic", "fine dining")
# Family activities are penalised unless either category text has one of these.
FAMILY_KEYWORDS = (
    "wildlife", "theme park", "park", "hawker", "family", "playground",
    "kids", "workshop",
)
PRIMARY_HIT_POINTS = 2
SECONDARY_HIT_POINTS = 1
MOTHER_HIT_POINTS = 2
EXACT_ITEMS_POINTS = 3
CUISINE_MISS_POINTS = -2
ATMOSPHERE_MISS_POINTS = -1
SOLO_MISS_POINTS = -1
SPORT_MISS_POINTS = -2
COUPLE_MISS_POINTS = -2
FAMILY_MISS_POINTS = -2
PREFERENCE_HIT_POINTS = 1
PROXIMITY_BONUS = 5.0
# ---------------------------------------------------------------------------

_MOTHER = "\u0001mother"


def category_pairs(catalog: DataFrame) -> DataFrame:
    return catalog.select("mc", "pc").distinct()


def _pair_tokens(pairs: DataFrame) -> DataFrame:
    mother = contains_any(F.col("pc"), MOTHER_KEYWORDS) | contains_any(
        F.col("mc"), MOTHER_KEYWORDS
    )
    tokens = F.array_distinct(
        F.concat(
            grams(F.col("pc")),
            grams(F.col("mc")),
            F.array(F.lit(EVERY_TEXT)),
            F.when(mother, F.array(F.lit(_MOTHER))).otherwise(F.array().cast("array<string>")),
        )
    )
    return pairs.select("mc", "pc", F.explode(tokens).alias("token"))


def _cat_tokens(cats: DataFrame) -> DataFrame:
    cat = F.col("fields.cat")
    low = F.lower(cat)
    everything = (cat == "general") | (low == "")
    first = F.when(everything, F.lit(EVERY_TEXT)).otherwise(F.substring(low, 1, GRAM))
    mother = (cat == "gifts") & (F.col("fields.recip") == "mother")
    tokens = F.when(mother, F.array(first, F.lit(_MOTHER))).otherwise(F.array(first))
    return cats.select("cat_id", "fields", F.explode(tokens).alias("token"))


def base_points(ask: Column, mc: Column, pc: Column) -> Column:
    """Integer part of the score of (key, category pair), or NULL when the
    category rules reject the pair (L5). Rows are added in the order of the
    scoring table so doubles sum exactly as the source application does."""
    cat = ask["cat"]
    term = F.lower(cat)
    general = cat == "general"
    c1 = ~general & pc.contains(term)
    c2 = ~general & ~c1 & mc.contains(term)
    mother = contains_any(pc, MOTHER_KEYWORDS) | contains_any(mc, MOTHER_KEYWORDS)
    c3 = ~general & ~c1 & ~c2 & (cat == "gifts") & (ask["recip"] == "mother") & mother
    matched = general | c1 | c2 | c3
    cat_pts = (
        F.when(c1, PRIMARY_HIT_POINTS)
        .when(c2, SECONDARY_HIT_POINTS)
        .when(c3, MOTHER_HIT_POINTS)
        .otherwise(0)
    )
    item_pts = F.when(ask["terms"].isNotNull(), EXACT_ITEMS_POINTS).otherwise(0)

    food = cat == "food"
    cuisine, atmos = ask["cuisine"], ask["atmos"]
    food_pts = F.when(
        food & (cuisine != "") & ~mc.contains(cuisine) & ~pc.contains(cuisine),
        CUISINE_MISS_POINTS,
    ).otherwise(0) + F.when(
        food & (atmos != "") & ~mc.contains(atmos), ATMOSPHERE_MISS_POINTS
    ).otherwise(0)

    act = cat == "activities"
    partic = ask["partic"]
    act_pts = (
        F.when(
            act & ask["solo"] & ~mc.contains("solo") & ~pc.contains("individual"),
            SOLO_MISS_POINTS,
        ).otherwise(0)
        + F.when(
            act & (ask["atype"] == "sports") & ~contains_any(mc, SPORT_KEYWORDS),
            SPORT_MISS_POINTS,
        ).otherwise(0)
        + F.when(
            act & (partic == "couple") & ~contains_any(mc, COUPLE_KEYWORDS),
            COUPLE_MISS_POINTS,
        )
        .when(
            act
            & (partic == "family")
            & ~(contains_any(mc, FAMILY_KEYWORDS) | contains_any(pc, FAMILY_KEYWORDS)),
            FAMILY_MISS_POINTS,
        )
        .otherwise(0)
    )

    prefs = ask["prefs"]
    pref_pts = F.when(
        prefs.isNotNull()
        & F.exists(prefs, lambda p: mc.contains(p) | pc.contains(p)),
        PREFERENCE_HIT_POINTS,
    ).otherwise(0)

    total = cat_pts + item_pts + food_pts + act_pts + pref_pts
    return F.when(matched, total.cast("double"))


def scored_pairs(cats: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cat_id, mc, pc, base) for every category-compatible (fields, pair).
    ``cats``: ``cat_id, fields`` (see ``category_fields``)."""
    cand = spread_join(
        _pair_tokens(pairs), _cat_tokens(cats), ["token"], ["mc", "pc"], name="cat_tokens", written=True
    ).select("cat_id", "fields", "mc", "pc").distinct()
    return cand.select(
        "cat_id", "mc", "pc", base_points(F.col("fields"), F.col("mc"), F.col("pc")).alias("base")
    ).filter(F.col("base").isNotNull())


def category_fields(ask: Column) -> Column:
    """The fields of a match key that ``base_points`` reads; of the item terms
    only whether there are any."""
    names = ("cat", "cuisine", "atmos", "partic", "solo", "atype", "recip", "prefs")
    some_terms = F.when(ask["terms"].isNotNull(), F.array(F.lit("")))
    return F.struct(*[ask[n].alias(n) for n in names], some_terms.alias("terms"))


def compact_id(value: Column) -> Column:
    """Digest of a struct: equal ids mean equal structs."""
    return F.md5(F.to_json(value))


def budget_ok(lo: Column, hi: Column, pmin: Column, pmax: Column, prices: Column) -> Column:
    """Some valid discounted price lies in [lo, hi] (L3 + L4), where the prices are a column.
    ``pricecells`` answers it without one."""
    return (
        F.when(F.isnan(lo) | F.isnan(hi) | pmax.isNull(), F.lit(False))
        .when((pmax < lo) | (pmin > hi), F.lit(False))
        .when((hi == float("inf")) | (lo <= pmin), F.lit(True))
        .otherwise(F.exists(prices, lambda p: (p >= lo) & (p <= hi)))
    )


def items_ok(terms: Column, names: Column) -> Column:
    """Every requested term is a substring of some item name."""
    return terms.isNull() | F.forall(
        terms, lambda t: F.exists(names, lambda n: n.contains(t))
    )


def item_matches(term_sets: DataFrame, names: DataFrame) -> DataFrame:
    """``terms, merchant_id``: merchants carrying every requested term, for
    distinct term sets ``terms`` (J5 containment join). ``names``:
    ``merchant_id, iname`` (lower-cased item names)."""
    return sets_fully_contained(term_sets, "terms", names, "merchant_id", "iname")


def with_list(keys: DataFrame) -> DataFrame:
    """``keys`` with ``place``, the point that distances are taken from (NULL: without
    proximity there are none), and ``list_id``: keys that differ in it only by filters
    share one posting list."""
    ask = F.col("ask")
    own = F.struct(ask["plat"].alias("lat"), ask["plon"].alias("lon"))
    place = F.struct(
        F.col("point").alias("point"), F.when(F.coalesce("point", F.lit(-1)) < 0, own).alias("own")
    )
    keys = keys.withColumn("place", F.when(ask["prox"].isNotNull(), place))
    return keys.withColumn("list_id", compact_id(F.struct("cat_id", "place", ask["terms"].alias("terms"))))


def posting_rows(
    merchants: DataFrame, scored: DataFrame, lists: DataFrame, names: DataFrame | None, score_digits: int | None
) -> DataFrame:
    """The merchants of every posting list with their distance and score; what does not
    depend on a key's budget, radius or rating is settled here. ``lists``: ``list_id, cat_id,
    place, terms``; ``names``: item names, where some list has terms."""
    fields = ["list_id", "place", "mc", "pc", "base"]
    plain = lists.filter(F.col("terms").isNull()).join(scored, "cat_id").select(*fields)
    rows = spread_join(merchants, plain, ["mc", "pc"], ["merchant_id"], name="list_pairs", written=True)
    if names is not None:
        # lists with item terms hold only the merchants that carry all of them
        with_terms = lists.filter(F.col("terms").isNotNull())
        hits = item_matches(with_terms.select("terms").distinct(), names).join(merchants, "merchant_id")
        scored_terms = with_terms.join(scored, "cat_id").select("terms", *fields)
        named = spread_join(hits, scored_terms, ["terms", "mc", "pc"], ["merchant_id"], name="term_lists", written=True)
        rows = rows.unionByName(named.drop("terms"))
    place = F.col("place")
    # a point outside the gazetteer has no precomputed distance
    own = haversine_km(place["own"]["lat"], place["own"]["lon"], F.col("lat"), F.col("lon"))
    dist = F.when(place.isNotNull(), F.when(place["point"] >= 0, F.get("dists", place["point"])).otherwise(own))
    bonus = F.when(
        F.col("dist_km").isNotNull(), py_max0(F.lit(PROXIMITY_BONUS) / (F.col("dist_km") + 1))
    ).otherwise(0.0)
    rank_score = F.col("score") if score_digits is None else F.round("score", score_digits)
    return (
        rows.withColumn("dist_km", dist)
        .withColumn("score", F.col("base") + bonus)
        .filter(F.col("score") > 0)
        .select(
            "list_id", rank_score.alias("rank_score"), "pos", "merchant_id", "dist_km", "score",
            "rating", "pmin", "pmax", "words",
        )
    )


def _preference() -> list[Column]:
    """Best first: score, then merchant position."""
    return [F.col("rank_score").desc(), F.col("pos").asc()]


#: The columns of ``_preference``, and whether each rises.
PREFERENCE = {"rank_score": False, "pos": True}


def _block_summary() -> list[Column]:
    """Unknown distances are nearer than any, unknown ratings better than any (NaN is the
    greatest number to Spark): both pass every filter."""
    dist, rating = F.col("dist_km"), F.col("rating")
    return [
        F.min(F.when(dist.isNull() | F.isnan(dist), float("-inf")).otherwise(dist)).alias("nearest"),
        F.max(F.when(rating.isNull(), float("nan")).otherwise(rating)).alias("best_rating"),
        F.min("pmin").alias("lowest"),
        F.max("pmax").alias("highest"),
        F.array(*pricecells.either(F.col("words"))).alias("occupied"),
    ]


def _with_budget(keys: DataFrame) -> DataFrame:
    """The filters of a key, its budget also as masks of price cells."""
    inside, edges = pricecells.budget_masks(F.col("ask.lo"), F.col("ask.hi"))
    return keys.select(
        "ask_id", "list_id", *[F.col(f"ask.{c}").alias(c) for c in ("prox", "minr", "lo", "hi")],
        inside.alias("inside"), edges.alias("edges"),
    )


def _may_pass() -> Column:
    prox, minr, lo, hi = (F.col(c) for c in ("prox", "minr", "lo", "hi"))
    occupied = F.col("occupied")
    cells = (hi == float("inf")) | pricecells.common(occupied, F.col("inside")) | pricecells.common(
        occupied, F.col("edges")
    )
    return (
        (prox.isNull() | (F.col("nearest") <= prox))
        & (minr.isNull() | (F.col("best_rating") >= minr))
        & ~(F.isnan(lo) | F.isnan(hi) | (F.col("highest") < lo) | (F.col("lowest") > hi))
        & cells
    )


def _passing(prices: pricecells.PriceCells) -> Callable[[DataFrame], DataFrame]:
    """Keeps the rows that satisfy their key's radius (L1), rating (L2) and budget (L3, L4)."""
    prox, minr, dist, rating = (F.col(c) for c in ("prox", "minr", "dist_km", "rating"))
    near = prox.isNull() | dist.isNull() | F.isnan(dist) | (dist <= prox)
    rated = minr.isNull() | rating.isNull() | F.isnan(rating) | (rating >= minr)
    columns = ("ask_id", "rank_score", "pos", "merchant_id", "dist_km", "score")

    def passes(read: DataFrame) -> DataFrame:
        budget = pricecells.verdict(F.col("lo"), F.col("hi"), F.col("inside"), F.col("edges"))
        rows = read.filter(near & rated).withColumn("fits", budget).filter("coalesce(fits, true)")
        rows = materialize(rows.select(*columns, "lo", "hi", "fits"), "block_matches")
        sure, unsure = rows.filter("fits").select(*columns), rows.filter("fits is null").drop("fits")
        if unsure.isEmpty():
            return sure
        return sure.unionByName(pricecells.settle(unsure, prices).select(*columns))

    return passes


MATCH_COLUMNS = (
    "merchant_id", "pos", "mc", "pc", "rating", "lat", "lon")


def with_ask_id(asks: DataFrame) -> DataFrame:
    """``asks`` with the compact id of its match key (NULL without one)."""
    return asks.withColumn(
        "ask_id", F.when(F.col("ask").isNotNull(), compact_id(F.col("ask")))
    ).drop("ask")


@dataclass
class Ranking:
    """Result of ``rank_keys``: ``ranked`` holds ``ask_id, rank, merchant_id, pos,
    dist_km, score`` (at most ``k`` rows per key), ``keys`` the materialised key
    dictionary, ``reads`` the (key, block) pairs that each round read."""

    ranked: DataFrame
    keys: DataFrame
    reads: list[DataFrame]

    def fan_out(
        self, left: DataFrame, per_key: DataFrame, how: str = "inner", written: bool = False
    ) -> DataFrame:
        """Join request rows ``left`` (``request_id, ask_id, ...``) to a per-key
        table. Requests without a key take no part in the join."""
        return spread_join(left, per_key, ["ask_id"], ["request_id"], how, "per_key", written)


def rank_keys(
    asks: DataFrame,
    catalog: DataFrame,
    k: int = TOP_K,
    score_digits: int | None = None,
    items: DataFrame | None = None,
    items_written: bool = False,
) -> Ranking:
    """Rank once per distinct match key (see the module notes). ``items``: the flat item
    relation (``merchant_id, name, price, discount_percent``); without it names and prices
    are taken from the catalog's arrays. With it, ``catalog`` may be ``match_merchants``.
    Items are read for cells, names and in each round for single prices: what is read of them
    is written once, unless ``items_written`` says that they are."""
    keys = asks.filter(F.col("ask").isNotNull()).groupBy("ask").agg(
        F.count(F.lit(1)).alias("n_requests")
    )
    keys = keys.select(
        compact_id(F.col("ask")).alias("ask_id"),
        "ask",
        "n_requests",
        compact_id(category_fields(F.col("ask"))).alias("cat_id"),
        point_index(F.col("ask.plat"), F.col("ask.plon")).alias("point"),
    )
    keys = materialize(with_list(keys), "keys")
    named = not keys.filter(F.col("ask.terms").isNotNull()).isEmpty()
    if items is None:
        priced = catalog.select("merchant_id", F.explode("prices").alias("dp"))
    else:
        read = item_prices(items).select("merchant_id", "dp", *["name"] * named)
        priced = read if items_written else materialize(read, "item_prices")
    prices = pricecells.price_cells(priced)
    # merchants without a valid price match nothing (L3, L4)
    merchants = materialize(
        catalog.select(*MATCH_COLUMNS, distances_km(F.col("lat"), F.col("lon")).alias("dists")).join(
            prices.merchants, "merchant_id"
        ),
        "merchants",
    )
    cats = keys.select("cat_id", category_fields(F.col("ask")).alias("fields")).distinct()
    scored = materialize(scored_pairs(cats, category_pairs(merchants)), "scored")
    lists = keys.select("list_id", "cat_id", "place", F.col("ask.terms").alias("terms")).distinct()
    names = None
    if named:
        names = (
            catalog.select("merchant_id", F.explode("names").alias("iname"))
            if items is None
            else priced.select("merchant_id", F.lower(F.coalesce("name", F.lit(""))).alias("iname"))
        )
    rows = posting_rows(merchants, scored, lists, names, score_digits)
    first = postings.top_k(
        _with_budget(keys), "ask_id", rows, k, _preference(), _block_summary(), _may_pass(),
        _passing(prices), "merchant_id", PREFERENCE,
    )
    ranked = first.found.select(
        "ask_id", F.col("place").alias("rank"), "merchant_id", "pos", "dist_km", "score"
    )
    return Ranking(ranked, keys, first.reads)


def top_merchants(
    asks: DataFrame,
    catalog: DataFrame,
    k: int = TOP_K,
    score_digits: int | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` merchants per request.

    ``asks``: ``request_id, ask`` (match key; NULL ask = no offers).
    ``catalog``: ``operators.catalog.build_catalog`` output.
    ``score_digits``: rank on the score rounded to this many digits (for
    comparisons with another engine whose math differs in the last bits);
    None ranks on the exact score. Ties go to the lower merchant position.

    Returns ``request_id, rank, merchant_id, pos, dist_km, score``.
    """
    asks = asks.filter(F.col("ask").isNotNull()).select("request_id", "ask")
    r = rank_keys(asks, catalog, k, score_digits, items)
    return r.fan_out(with_ask_id(asks), r.ranked, written=True).select(
        "request_id", "rank", "merchant_id", "pos", "dist_km", "score"
    )
