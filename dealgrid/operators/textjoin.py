"""Substring containment as an equi-join.

``contains_pairs(terms, texts)`` returns every (term, text) with
``text.contains(term)``. Each text emits its distinct substrings of length
1..3 (``grams``); each term emits one gram of its own: of its three-character
substrings (a shorter term: itself) the one that the fewest texts hold. Containment
implies that gram is among the text's grams, so the equi-join on the gram is
a superset of the answer and an exact ``contains`` filter settles it. A prefix
that many terms and texts share thus costs nothing, as another gram of the term is rarer,
and a term with a gram that no text holds is dropped before the join. The
empty term is contained in every text: it joins on a token every text emits.
Both sides are dictionaries (distinct terms, distinct texts), so the work is
proportional to the text length, never to |terms| x |texts|.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.plans.sizing import materialize, relation_bytes
from dealgrid.plans.skew import dictionary_limit, spread_join

GRAM = 3
EVERY_TEXT = "\u0001all"


def grams(text: Column) -> Column:
    """Substrings of ``text`` of length 1..GRAM (may repeat)."""
    n = F.greatest(F.length(text), F.lit(1))
    per_start = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array(*[F.substring(text, i, g) for g in range(1, GRAM + 1)]),
    )
    return F.filter(F.flatten(per_start), lambda s: F.length(s) > 0)


def term_grams(term: Column) -> Column:
    """Distinct substrings of length GRAM (of a shorter term: the term), one of which a
    term is found by."""
    last = F.greatest(F.length(term) - (GRAM - 1), F.lit(1))
    parts = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(term, i, GRAM))
    return F.when(term == "", F.array(F.lit(EVERY_TEXT))).otherwise(F.array_distinct(parts))


def rarest_tokens(terms: DataFrame, text_grams: DataFrame) -> DataFrame:
    """``_term, _tok``: the gram of each term that the fewest texts hold (ties: the
    smaller one). ``text_grams(_text, _tok)`` holds each gram of a text once. Terms with a gram
    that no text holds are left out: no text contains them."""
    held = text_grams.groupBy("_tok").agg(F.count(F.lit(1)).alias("_n"))
    own = terms.withColumn("_grams", term_grams(F.col("_term")))
    own = own.select("_term", F.size("_grams").alias("_size"), F.explode("_grams").alias("_tok"))
    # one gram may be in very many terms
    met = spread_join(own, held, ["_tok"], ["_term"], name="gram_counts")
    best = met.groupBy("_term").agg(
        F.min(F.struct("_n", "_tok")).alias("_best"),
        F.count(F.lit(1)).alias("_met"),
        F.first("_size").alias("_size"),
    )
    return best.filter("_met = _size").select("_term", F.col("_best._tok").alias("_tok"))


def text_tokens(text: Column) -> Column:
    return F.array_distinct(F.concat(grams(text), F.array(F.lit(EVERY_TEXT))))


def contains_pairs(terms: DataFrame, term_col: str, texts: DataFrame, text_col: str) -> DataFrame:
    """Distinct ``(term_col, text_col)`` pairs where the text contains the term."""
    t = terms.select(F.col(term_col).alias("_term")).distinct().filter(
        F.col("_term").isNotNull()
    )
    x = texts.select(F.col(text_col).alias("_text")).distinct().filter(
        F.col("_text").isNotNull()
    )
    right = x.select("_text", F.explode(text_tokens(F.col("_text"))).alias("_tok"))
    left = rarest_tokens(t, right)
    # the rarest gram (or the empty term's token) may still be in every text
    return (
        spread_join(right, left, ["_tok"], ["_text"], name="term_tokens")
        .filter(F.col("_text").contains(F.col("_term")))
        .select(F.col("_term").alias(term_col), F.col("_text").alias(text_col))
        .distinct()
    )


def sets_fully_contained(
    term_sets: DataFrame, set_col: str, texts: DataFrame, owner_col: str, text_col: str
) -> DataFrame:
    """``(set_col, owner_col)`` for every term set and owner where each term
    of the set is contained in some text of the owner (J5, F10).

    ``term_sets`` holds distinct arrays of distinct terms; ``texts`` holds
    ``(owner, text)`` rows. Terms and texts meet in ``contains_pairs``; the
    per-(set, owner) term count is a partial aggregation.
    """
    set_terms = term_sets.select(set_col, F.explode(set_col).alias("_t")).distinct()
    owner_texts = texts.select(owner_col, text_col)
    hits = materialize(contains_pairs(set_terms, "_t", owner_texts, text_col), "text_hits")
    if relation_bytes(hits) > dictionary_limit(hits.sparkSession):
        # all rows are shuffled: an owner's repeated texts once
        owner_texts = owner_texts.distinct()
    # a text may belong to very many owners (one item name across merchants), and a
    # term may hit very many of them
    owner_terms = spread_join(owner_texts, hits, [text_col], [owner_col], written=True)
    owner_terms = owner_terms.select(owner_col, "_t").distinct()
    return (
        spread_join(owner_terms, set_terms, ["_t"], [owner_col], name="set_terms", written=True)
        .groupBy(set_col, owner_col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == F.size(F.array_distinct(set_col)))
        .select(set_col, owner_col)
    )
