"""Interaction of document filters, in every order of application (operator 11).

Each document fails some of the filters; that set is its *mask*. Documents are counted
per part and mask, which leaves at most 2 ^ filters *cells* a part. Gray-code
walk: the subsets of filters are visited so that each differs from the one before by a
single filter. Toggling it changes, in the cells that fail it, the number of
active filters they fail; a cell joins or leaves the survivors when that counter leaves
or reaches 0. The survivors of all subsets are the *states* (32 for five filters),
one row a part. A step of an order leads from one subset to a larger one, so its figures
are differences of two states.

Distribution: texts are read once, in Arrow batches, and leave as flags and a SHA-256
digest. Copies are found by an aggregation on the digest (combined before the shuffle)
and a join on digest and doc_id together, so a text that a third of the documents share
is not one task's. Labels meet the flags in an inner join on doc_id, after equal rows are
merged. Cells are summed before they are shuffled; parts are spread over
tasks and one part takes ``2 ^ filters`` numbers. Nothing is collected.

Defined cases: null text is empty text; a null part is the empty string; a null doc_id is
smaller than no other and has no labels, so its document never fails for being a copy;
rows that repeat a doc_id and its text count each, and none is a copy of the other; a
doc_id labelled several times has a label if any row gives it; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import decoded, table, tidy
from dealgrid.plans.sizing import materialize

LETTERS = "ABCDE"
COPY = LETTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
CAPITALS = string.ascii_uppercase.encode()
#: Orders are the factorial of the filters, states 2 to their power.
MOST_FILTERS = 8
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(raw: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails. ``bytes.split`` cuts at
    ``[\\x20\\x09-\\x0D]+``, as the contract's words do."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITAL_PERCENT * code_points,
        symbols > 0,
    )
    return sum(bit << i for i, bit in enumerate(fails))


def text_flags(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, mask, digest`` of every document; the mask without the copies."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("binary").alias("_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            raw = batch.column("_text")
            for value, text in zip(raw, decoded(raw), strict=True):
                value = value.as_py() or b""
                masks.append(text_mask(value, len(text)))
                digests.append(hashlib.sha256(value).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "part", "mask", "digest"],
            )

    return rows.mapInArrow(tidy(run), "doc_id long, part string, mask int, digest binary")


def with_copies(flags: DataFrame, bit: int = COPY) -> DataFrame:
    """``doc_id, part, mask, n``: equal rows merged, and the bit set for documents whose
    digest a smaller doc_id has."""
    merged = materialize(
        flags.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "filter_flags"
    )
    first = merged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    named = merged.filter("doc_id is not null").join(
        first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left"
    )
    fails = F.when(F.col("first").isNull(), F.lit(1 << bit)).otherwise(F.lit(0))
    columns = ["doc_id", "part", "mask", "n"]
    return named.withColumn("mask", F.col("mask").bitwiseOR(fails)).select(*columns).unionByName(
        merged.filter("doc_id is null").select(*columns)
    )


def cells(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of a mask, and how many of them are labelled
    of good quality or toxic. ``flags``: ``doc_id, part, mask, n``."""
    marks = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
    )
    labelled = flags.join(marks, "doc_id").select(
        "part", "mask", F.lit(0).cast("long").alias("n"),
        (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"),
    )
    none = F.lit(0).cast("long")
    return (
        flags.select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
        .unionByName(labelled)
        .groupBy("part", "mask")
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    )


def walk(sizes: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every subset of filters, by subset: ``sizes`` has the counts of each
    mask, one column a kind of count."""
    masks = np.arange(1 << n_filters)
    failing = np.zeros(1 << n_filters, np.int64)  # active filters that a cell fails
    running = sizes.sum(axis=0)
    states = np.empty((1 << n_filters, sizes.shape[1]), np.int64)
    states[0] = running
    subset = 0
    for visit in range(1, 1 << n_filters):
        bit = (visit & -visit).bit_length() - 1  # the filter that the Gray code toggles
        subset ^= 1 << bit
        own = np.flatnonzero(masks >> bit & 1)
        if subset >> bit & 1:
            running = running - sizes[own[failing[own] == 0]].sum(axis=0)
            failing[own] += 1
        else:
            failing[own] -= 1
            running = running + sizes[own[failing[own] == 0]].sum(axis=0)
        states[subset] = running
    return states


def states(cell_counts: DataFrame, n_filters: int) -> DataFrame:
    """One row a part: the survivors of each subset (``kept, good, toxic``, by subset), and
    how many documents fail each filter (``fails``), and it alone (``alone``)."""
    if not 0 < n_filters <= MOST_FILTERS:
        raise ValueError(f"{n_filters} filters; from 1 to {MOST_FILTERS}")
    grouped = cell_counts.groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column("cells").to_pylist():
                sizes = np.zeros((1 << n_filters, 3), np.int64)
                for cell in own:
                    sizes[cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
                after = walk(sizes, n_filters)
                fails = [int(sizes[np.arange(1 << n_filters) >> f & 1 == 1, 0].sum()) for f in range(n_filters)]
                alone = [int(sizes[1 << f, 0]) for f in range(n_filters)]
                rows.append((*after.T.tolist(), fails, alone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part")]
                + [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(5)],
                ["part", "kept", "good", "toxic", "fails", "alone"],
            )

    names = ("kept", "good", "toxic", "fails", "alone")
    return grouped.mapInArrow(tidy(run), "part string, " + ", ".join(f"{n} array<long>" for n in names))


def steps(survivors: DataFrame, letters: str) -> DataFrame:
    """Every step of every order: differences of two states of ``states``."""
    orders = [
        [(f, sum(1 << g for g in order[:i])) for i, f in enumerate(order)]
        for order in itertools.permutations(range(len(letters)))
    ]
    names = ["".join(letters[f] for f, _ in order) for order in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = [step for order in orders for step in order]
        which = np.array([f for f, _ in flat])
        before = np.array([subset for _, subset in flat])
        after = before | 1 << which
        order_names = np.repeat(names, len(letters))
        places = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for row in batch.to_pylist():
                kept, good, toxic, fails, alone = (
                    np.array(row[c], np.int64) for c in ("kept", "good", "toxic", "fails", "alone")
                )
                removed = kept[before] - kept[after]
                shapley = np.zeros(len(letters), np.int64)
                np.add.at(shapley, which, removed)
                figures = (
                    kept[after], removed, fails[which] - removed, alone[which],
                    good[before] - good[after], toxic[before] - toxic[after], shapley[which],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(flat)), pa.array(order_names), pa.array(places)]
                    + [pa.array(f) for f in figures],
                    ["part", "filter_order", "step", *FIGURES],
                )

    kinds = ", ".join(f"{f} long" for f in FIGURES)
    return survivors.mapInArrow(tidy(run), f"part string, filter_order string, step int, {kinds}")


def audit(flags: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Figures of every step of every order of the filters, per part. ``flags``: ``doc_id, part,
    mask, n`` (bit i of the mask: fails the filter ``letters[i]``)."""
    survivors = states(cells(materialize(flags, "filter_masks"), labels), len(letters))
    return steps(materialize(survivors, "filter_states"), letters)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    flags = with_copies(text_flags(docs, F.col("lang")))
    return audit(flags, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts
), masked AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM worded
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, letter, bit,
    (SELECT coalesce(sum(y.bit), 0) FROM letters y
      WHERE contains(substr(filter_order, 1, step - 1), y.letter))::INTEGER AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) p, letters
  WHERE substr(filter_order, step, 1) = letter
), figures AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM figures
"""
