"""Containment join: terms are found by their rarest gram."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from dealgrid.operators import textjoin
from dealgrid.operators.textjoin import contains_pairs, rarest_tokens, text_tokens


def _frames(spark, terms, texts):
    return (
        spark.createDataFrame([(t,) for t in terms], "term string"),
        spark.createDataFrame([(t,) for t in texts], "text string"),
    )


def test_shared_prefix_does_not_meet(spark):
    """Every term and text starts alike: candidates stay near the answer, where first grams
    would make terms x texts."""
    names = [f"set menu {chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(65 + k // 676)}" for k in range(1500)]
    terms, texts = _frames(spark, names, [f"{n}!" for n in names])
    t = terms.select(F.col("term").alias("_term"))
    grams = texts.select(F.col("text").alias("_text"), F.explode(text_tokens(F.col("text"))).alias("_tok"))
    candidates = grams.join(rarest_tokens(t, grams), "_tok")
    per_gram = candidates.groupBy("_tok").count().agg(F.max("count")).first()[0]
    assert candidates.count() < 70 * len(names) < len(names) ** 2 / 20
    assert per_gram < len(names) ** 2 / 100
    assert contains_pairs(terms, "term", texts, "text").count() == len(names)


def test_same_pairs_as_nested_loop(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("aabé z") for _ in range(draw.randrange(n)))
    names = list({word(6) for _ in range(80)} | {"", "a", "zz", "not held anywhere"})
    lines = list({word(14) for _ in range(120)} | {"", "a"})
    terms, texts = _frames(spark, [*names, names[0], None], [*lines, lines[0], None])
    found = [tuple(r) for r in contains_pairs(terms, "term", texts, "text").select("term", "text").collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(t, x) for t in names for x in lines if t in x}
    assert contains_pairs(terms, "term", texts.limit(0), "text").count() == 0


def test_a_term_of_one_gram_keeps_it(spark):
    terms, texts = _frames(spark, ["ab", "abcd"], ["xabx", "abcd", "bcd"])
    grams = texts.select(F.col("text").alias("_text"), F.explode(text_tokens(F.col("text"))).alias("_tok"))
    found = rarest_tokens(terms.select(F.col("term").alias("_term")), grams).collect()
    assert {tuple(r) for r in found} == {("ab", "ab"), ("abcd", "abc")}
    assert textjoin.GRAM == 3
