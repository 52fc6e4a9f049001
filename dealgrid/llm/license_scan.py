"""License scan by exact set-similarity join (operator 4).

Base phrases are found where their words stand consecutively. The method's own
labels come from a join of the text blocks (lines) with license templates: every
(block, template) pair whose containment, the share of the template's distinct
words that occur in the block, reaches ``CONTAINMENT``:

* words are ordered by their frequency over all blocks, rarest first; a match
  must hold one of a template's first |T| - needed + 1 words (prefix filter), so
  blocks are joined to templates by those words only;
* a block with fewer distinct words than needed is left out (length filter);
* the ranks of the shared word in template and block bound the overlap that is
  still possible (positional filter);
* what remains is verified on the whole sets, so the result is exact.

Templates are a parameter and few; their words and prefixes are literals or a
broadcast of a few hundred rows. Blocks carry only their template words, so the
stored table is small; nothing is shuffled but counts and matches, and no block
meets another block.

Defined cases: null text is empty (no words, score 0); repeated rows repeat; ties
cannot arise, all matches count; rows with null ids are kept; columns other than
id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import ascii_lower, table, whole_text
from dealgrid.plans.sizing import materialize

PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: label -> notices. One label may have several.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
    ),
    "mpl": ("subject to the terms of the mozilla public license v 2 0",),
    "cc-by": ("licensed under cc by 4 0", "creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "public-domain": ("this work is dedicated to the public domain",),
    "reserved": ("all rights reserved",),
}
CONTAINMENT = 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """The words of the text with one blank between, A-Z lower-cased."""
    return F.trim(F.regexp_replace(ascii_lower(whole_text(text)), NOT_WORD, " "))


def _starts(norm: Column, words: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand, as array<int>."""
    parts = phrase.split(" ")

    def at(_: Column, i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.when(same, i)

    found = F.filter(F.transform(words, at), lambda x: x.isNotNull())
    there = F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(there, found).otherwise(F.array().cast("array<int>"))


def phrase_places(
    docs: DataFrame, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, body (hash of the text), n_words, places (array of label and start)."""
    phrases = phrases or PHRASES
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("body"), plain(F.col(text_col)).alias("norm"))
    any_hit = F.lit(False)
    for phrase in phrases:
        any_hit = any_hit | F.contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")), F.lit(f" {phrase} "))
    n_words = F.when(F.col("norm") == "", 0).otherwise(
        F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1
    )
    rows = rows.select(
        id_col, "body", "norm", n_words.cast("long").alias("n_words"),
        F.when(any_hit, F.split("norm", " ")).alias("words"),
    )

    def labelled_starts(phrase: str, label: str) -> Column:
        return F.transform(
            _starts(F.col("norm"), F.col("words"), phrase),
            lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")),
        )

    labelled = [labelled_starts(phrase, label) for phrase, label in phrases.items()]
    places = F.when(F.col("words").isNotNull(), F.concat(*labelled)).otherwise(
        F.array().cast("array<struct<label:string,start:bigint>>")
    )
    return rows.select(id_col, "body", "n_words", places.alias("places"))


def _templates(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, texts in templates.items() for text in texts]


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def template_matches(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None,
    containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, body, block (line number from 0), label and containment of every
    (block, template) pair that meets the threshold."""
    spark = docs.sparkSession
    sets = _templates(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    literal = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col), F.xxhash64(text_col).alias("body"), F.posexplode(F.split(text_col, "\n", -1)).alias("block", "line")
    )
    rows = rows.select(id_col, "body", "block", plain(F.col("line")).alias("norm"))
    rows = rows.select(id_col, "body", "block", F.array_distinct(F.split("norm", " ")).alias("words"))
    rows = rows.select(
        id_col, "body", "block", F.size("words").alias("size"), F.array_intersect("words", literal).alias("common")
    )
    blocks = materialize(rows.filter(F.size("common") > 0), "blocks")

    counts = blocks.select(F.explode("common").alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}  # at most the template words
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t, (label, words) in enumerate(sets):
        ranked = sorted(rank[w] for w in words)
        least = needed(len(ranked), containment)
        for at, r in enumerate(ranked[: len(ranked) - least + 1]):
            index.append((r, at, t, label, ranked, len(ranked), least))
    prefix = spark.createDataFrame(
        index, "rank int, at int, template int, label string, members array<int>, members_n int, least int"
    )
    ranks = F.map_from_arrays(literal, F.array(*[F.lit(rank[w]) for w in vocabulary]).cast("array<int>"))
    starts = sorted({row[0] for row in index})
    ranked = blocks.select(
        id_col, "body", "block", "size",
        F.array_sort(F.transform("common", lambda w: F.element_at(ranks, w))).alias("have"),
    )
    tokens = ranked.withColumn(
        "rank", F.explode(F.array_intersect("have", F.array(*[F.lit(s) for s in starts]).cast("array<int>")))
    )
    pairs = tokens.join(F.broadcast(prefix), "rank")
    here = F.array_position("have", F.col("rank")) - 1
    possible = (
        F.least(F.col("at"), here) + 1
        + F.least(F.col("members_n") - F.col("at"), F.size("have") - here) - 1
    )
    pairs = pairs.filter((F.col("size") >= F.col("least")) & (possible >= F.col("least")))
    # a pair that shares several prefix words is kept at the rarest of them
    met = F.array_intersect("have", "members")
    pairs = pairs.withColumn("met", met).filter(
        (F.col("rank") == F.array_min("met")) & (F.size("met") >= F.col("least"))
    )
    return pairs.select(
        id_col, "body", "block", "template", "label",
        (F.size("met") / F.col("members_n")).alias("containment"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: words, base places and labels, the
    method's labels, and the greatest containment (1 with a base place)."""
    base = phrase_places(docs, None, id_col, text_col)
    matched = template_matches(docs, None, CONTAINMENT, id_col, text_col).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), "body", "label", "containment"
    )
    matched = matched.groupBy("_key", "body").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("most")
    )
    both = base.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).join(
        matched, ["_key", "body"], "left"
    )
    starts = F.transform("places", lambda p: p["start"])
    base_labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return both.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, found)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    notices = ", ".join(
        f"({t}, '{label}', {words!r}, {needed(len(words), CONTAINMENT)})"
        for t, (label, words) in enumerate(_templates(TEMPLATES))
    )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT doc_id, {lower} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS w FROM d),
phrase(p, label) AS (VALUES {phrases}),
place AS (
  SELECT doc_id, label, u.i - 1 AS start FROM w JOIN phrase ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' '),
    unnest(range(1, len(w) + 1)) AS u(i)
  WHERE w[u.i : u.i + len(string_split(p, ' ')) - 1] = string_split(p, ' ')),
base AS (
  SELECT doc_id, count(*) AS n, min(start) AS a, max(start) AS b, list_sort(list(DISTINCT label)) AS labels
  FROM place GROUP BY doc_id),
notice(id, label, words, least) AS (VALUES {notices}),
block AS (
  SELECT doc_id, u.i AS i, list_distinct(regexp_extract_all(string_split(t, chr(10))[u.i], {word})) AS words
  FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
hit AS (
  SELECT doc_id, label, len(list_intersect(block.words, notice.words)) / len(notice.words) AS share
  FROM block JOIN notice ON len(block.words) >= least AND len(list_intersect(block.words, notice.words)) >= least),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
  CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(met.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""


SQL = _sql()
