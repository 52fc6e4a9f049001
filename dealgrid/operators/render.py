"""Text projections: labels, profiles, offer summaries, prompts, log rows,
outcome messages (SURVEY P1-P10, O4, F14, F15).

Numbers stay numeric columns next to their display text. Display rounding
(``text.fmt_fixed``) rounds half-even on the exact binary value, like
Python's ``.0f`` / ``.1f`` / ``.2f``. Prompt wording is this project's own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealgrid.functions.text import fmt_fixed, iso_now, py_float_repr, py_str_repr, py_strip

# --- Outcome messages (own wording) ----------------------------------------
MSG_CUSTOMER_NOT_FOUND = "Customer not found: no offers for an unknown customer id."
MSG_NO_MATCH = "No merchant matches this request; try a broader one."
MSG_NO_TEXT = "The offer text could not be generated; please retry."
MSG_QUARANTINED = "The request could not be interpreted"
MSG_ERROR = "The offer text failed"
# ---------------------------------------------------------------------------


def fmt_whole(x: Column) -> Column:
    """``f"{x:.0f}"`` (half-even, ``-0`` for small negatives)."""
    return fmt_fixed(x, 0)


def py_text(c: Column) -> Column:
    """``str(value)`` inside an f-string: NULL prints as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


# --- Fixed layout (display lines that must read as in the source application) --
def customer_label(
    cid: Column, name: Column, age: Column, sex: Column, district: Column, balance: Column
) -> Column:
    """``"{id}: {name} ({age} {sex}, {district}, ${balance:.0f})"``; a
    missing district prints empty and a missing balance as 0."""
    return F.concat(
        py_text(cid), F.lit(": "), py_text(name), F.lit(" ("), py_text(age), F.lit(" "),
        py_text(sex), F.lit(", "), F.coalesce(district, F.lit("")), F.lit(", $"),
        fmt_whole(F.coalesce(balance.cast("double"), F.lit(0.0))), F.lit(")"),
    )


def transactions_text(txns: Column, with_amount: bool = True, written: bool = False) -> Column:
    """Python list-of-tuples text of ``array<struct<merchant_id, category,
    amount>>`` in array order; NULL list -> ``[]``. ``written``: the structs also hold
    ``text_id`` and ``amount_shown``, the id's kind and the amount as in the record."""
    def one(t: Column) -> Column:
        if written:
            mid = F.when(t["text_id"], py_str_repr(t["merchant_id"])).otherwise(py_text(t["merchant_id"]))
            amount = py_text(t["amount_shown"])
        else:
            mid = py_text(t["merchant_id"])
            amount = py_text(py_float_repr(t["amount"]))
        parts = [mid, F.lit(", "), py_str_repr(t["category"])]
        if with_amount:
            parts += [F.lit(", "), amount]
        return F.concat(F.lit("("), *parts, F.lit(")"))

    items = F.transform(F.coalesce(txns, F.array()), one)
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


# ---------------------------------------------------------------------------


def profile_text(with_amounts: bool = True, written: bool = False) -> Column:
    """Customer profile block for prompts (own layout), from the columns
    ``name, age, sex, occupation, balance, district, transactions``; the
    offer prompt lists transactions without amounts."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), py_text(F.col("name"))),
        F.concat(F.lit("Age: "), py_text(F.col("age")), F.lit(", Sex: "), py_text(F.col("sex"))),
        F.concat(F.lit("Occupation: "), py_text(F.col("occupation"))),
        F.concat(F.lit("Balance: $"), fmt_fixed(F.coalesce(F.col("balance"), F.lit(0.0)), 2)),
        F.concat(F.lit("Location: "), py_text(F.col("district"))),
        F.concat(
            F.lit("Recent transactions: "),
            transactions_text(F.col("transactions"), with_amount=with_amounts, written=written),
        ),
    )


def item_lines(items: Column) -> Column:
    """Offer summary items: the first 3 by position, price and discount taken
    as numbers (discount not clamped); an item whose price or discount is null or
    not a number is skipped (the loader reads an absent one as 0).
    ``array<struct<pos, name, price, discount_percent, discounted>>``."""
    first = F.slice(F.array_sort(items), 1, 3)
    typed = F.transform(
        first,
        lambda it: F.struct(
            it["pos"].alias("pos"),
            it["name"].alias("name"),
            it["price"].cast("double").alias("price"),
            it["discount_percent"].cast("double").alias("discount_percent"),
        ),
    )
    usable = F.filter(
        typed, lambda it: it["price"].isNotNull() & it["discount_percent"].isNotNull()
    )
    return F.transform(
        usable,
        lambda it: F.struct(
            it["pos"].alias("pos"),
            it["name"].alias("name"),
            it["price"].alias("price"),
            it["discount_percent"].alias("discount_percent"),
            (it["price"] * (1 - it["discount_percent"] / 100)).alias("discounted"),
        ),
    )


def item_line_text(it: Column) -> Column:
    return F.concat(
        F.lit("  - "), py_text(it["name"]), F.lit(": was $"), fmt_fixed(it["price"], 2),
        F.lit(", now $"), fmt_fixed(it["discounted"], 2), F.lit(" ("),
        fmt_whole(it["discount_percent"]), F.lit("% off)"),
    )


def merchant_header(name: Column, primary: Column, rating: Column, dist: Column) -> Column:
    """``rating`` is the text shown (``rating_shown``), NULL prints as ``None``."""
    dist_txt = F.when(dist.isNotNull(), F.concat(F.lit(", "), fmt_fixed(dist, 1), F.lit(" km")))
    return F.concat(
        F.lit("- "), py_text(name), F.lit(" ["), py_text(primary), F.lit(", rating "),
        py_text(rating), F.coalesce(dist_txt, F.lit("")), F.lit("]"),
    )


# --- Prompt wording (own) ----------------------------------------------------
EXTRACT_HEAD = (
    "Turn the shopper's request into one JSON object with the keys "
    "category (travel, food, activities, gifts or general), subcategory, "
    "exact_items, price_range, proximity_km, min_rating, specifics "
    "(destination, mode, duration, participants, recipient, cuisine, "
    "atmosphere, delivery, legal, bundle, solo, type), is_generic, "
    "is_ambiguous and confidence. Use null or false when unsure. "
    "Reply with the JSON object only.\nRequest: "
)
REFINE_PARTS = (
    "Request: ",
    "\nFirst reading of the request:\n",
    "\nShopper profile:\n",
    "\nGiven the request, the first reading and the profile, reply with an "
    "improved JSON object with the same keys. List exact_items only when the "
    "shopper named concrete items. Reply with the JSON object only.",
)
PREFERENCE_PARTS = (
    "Shopper profile:\n",
    "\nReply with a JSON list of short preference words for a ",
    " request, such as [\"vegan\", \"late opening\"]. JSON list only.",
)
OFFER_PARTS = (
    "You suggest offers from local merchants.\nShopper profile:\n",
    "\nRequest reading:\n",
    "\nMerchants to choose from:\n",
    "\nRecommend two or three of these merchants only, with reasons; state "
    "original price, discount and discounted price for each item you name."
    "\nRequest: ",
)
# ---------------------------------------------------------------------------


def extract_prompt(request_text: Column) -> Column:
    return F.concat(F.lit(EXTRACT_HEAD), F.coalesce(request_text, F.lit("")))


def refine_prompt(request_text: Column, intent_json: Column, profile: Column) -> Column:
    a, b, c, d = REFINE_PARTS
    return F.concat(
        F.lit(a), F.coalesce(request_text, F.lit("")),
        F.lit(b), F.coalesce(intent_json, F.lit("{}")),
        F.lit(c), profile, F.lit(d),
    )


def preference_prompt(category: Column, profile: Column) -> Column:
    a, b, c = PREFERENCE_PARTS
    return F.concat(
        F.lit(a), profile, F.lit(b), F.coalesce(category, F.lit("general")), F.lit(c)
    )


def offer_prompt(
    profile: Column, intent_json: Column, summary: Column, request_text: Column
) -> Column:
    a, b, c, d = OFFER_PARTS
    return F.concat(
        F.lit(a), profile,
        F.lit(b), F.coalesce(intent_json, F.lit("{}")),
        F.lit(c), F.coalesce(summary, F.lit("")), F.lit(d), F.coalesce(request_text, F.lit("")),
    )


def pretty_json(value: Column) -> Column:
    """Indented JSON of a struct, null fields written (P7, P9). Lists stay on
    one line; otherwise the layout of a two-space indent."""
    text = F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})
    return F.regexp_replace(text, r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")


def variant_json(value: Column) -> Column:
    """JSON of a VARIANT, an object with a line for each of its keys, in their order by
    name (P7, P9); what the keys hold stays on one line."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def line(entry: Column) -> Column:
        one = F.to_json(F.create_map(entry["key"], entry["value"]))
        return F.concat(F.lit("  "), F.substring(one, F.lit(2), F.length(one) - 2))

    lines = F.array_join(F.transform(entries, line), ",\n")
    return (
        F.when(entries.isNull(), F.to_json(value))
        .when(F.size(entries) == 0, F.lit("{}"))
        .otherwise(F.concat(F.lit("{\n"), lines, F.lit("\n}")))
    )


def ids_json(ids: Column) -> Column:
    """``json.dumps(list)`` layout ``[1, "m-7"]`` from an array of numeric ids
    or of ids already written as JSON text (``id_json`` of the JSON-lines
    loader); NULL ids are left out (L10)."""
    kept = F.filter(ids, lambda x: x.isNotNull())
    return F.concat(
        F.lit("["), F.array_join(F.transform(kept, lambda x: x.cast("string")), ", "), F.lit("]")
    )


def listing_label(rank: Column, name: Column, merchant_id: Column) -> Column:
    """Matched-merchant listing line (P5): ``Merchant {rank}: {name} (ID: {id})``."""
    return F.concat(
        F.lit("Merchant "), rank.cast("string"), F.lit(": "), py_text(name),
        F.lit(" (ID: "), py_text(merchant_id), F.lit(")"),
    )


def merchant_block(name: Column, primary: Column, rating: Column, dist: Column,
                   items: Column) -> Column:
    """One merchant of the offer summary (P4): header line, then item lines."""
    lines = F.transform(item_lines(items), item_line_text)
    return F.concat_ws("\n", merchant_header(name, primary, rating, dist), F.array_join(lines, "\n"))


def offer_text(
    status: Column, n_offers: Column, response: Column, error: Column | None = None
) -> Column:
    """Outcome message chain (O4): unknown customer, unusable intent, no match, failed
    call (``error`` is its message), blank response, response text."""
    text = py_strip(F.coalesce(response, F.lit("")))
    error = F.lit(None).cast("string") if error is None else error
    return (
        F.when(status == "customer_not_found", F.lit(MSG_CUSTOMER_NOT_FOUND))
        .when(status != "ok", F.concat(F.lit(MSG_QUARANTINED + " ("), status, F.lit(").")))
        .when(F.coalesce(n_offers, F.lit(0)) == 0, F.lit(MSG_NO_MATCH))
        .when(error.isNotNull(), F.concat(F.lit(MSG_ERROR + ": "), error))
        .when(text == "", F.lit(MSG_NO_TEXT))
        .otherwise(text)
    )


def log_time(ts: Column | None = None) -> Column:
    """ISO text like ``datetime.isoformat()``: microseconds only when non-zero."""
    if ts is None:
        return iso_now()
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    short = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", short).otherwise(full)
