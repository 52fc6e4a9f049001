"""The audit against masks worked out by hand, and its edge cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealgrid.llm import filter_audit as fa

LONG = " ".join(f"w{i}" for i in range(200))


def by_definition(rows, labels, letters):
    """``rows``: (doc_id, part, mask). Each order applied document by document."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out, total = {}, {}
    for part in {p for _, p, _ in rows}:
        own = [(d, m) for d, p, m in rows if p == part]
        for order in itertools.permutations(letters):
            left = list(own)
            for step, letter in enumerate(order, 1):
                bit = 1 << letters.index(letter)
                gone = [(d, m) for d, m in left if m & bit]
                left = [(d, m) for d, m in left if not m & bit]
                failing = sum(bool(m & bit) for _, m in own)
                out[part, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), sum(m == bit for _, m in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                )
                total[part, letter] = total.get((part, letter), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(flags, labels, letters):
    rows = fa.audit(flags, labels, letters).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[f] for f in fa.FIGURES) for r in rows}


@pytest.mark.parametrize("letters", ["AB", "PQRS"])
def test_every_step_by_definition(spark, letters):
    draw = np.random.default_rng(5)
    rows = [
        (int(i), str(draw.choice(["x", "y", ""])), int(m))
        for i, m in enumerate(draw.integers(0, 1 << len(letters), 300))
    ]
    labels = [(int(d), int(q), int(t)) for d, q, t in zip(*draw.integers(0, [[300], [2], [2]], (3, 120)), strict=True)]
    merged: dict[int, tuple] = {}
    for d, q, t in labels:
        merged[d] = (d, max(q, merged.get(d, (0, 0, 0))[1]), max(t, merged.get(d, (0, 0, 0))[2]))
    flags = spark.createDataFrame(rows, "doc_id long, part string, mask int").withColumn("n", F.lit(1).cast("long"))
    found = audited(flags, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), letters)
    assert found == by_definition(rows, list(merged.values()), letters)


def test_walk_visits_every_subset():
    sizes = np.arange(24).reshape(8, 3)
    states = fa.walk(sizes, 3)
    for subset in range(8):
        alive = [m for m in range(8) if not m & subset]
        assert states[subset].tolist() == sizes[alive].sum(axis=0).tolist()


def test_masks_at_the_thresholds():
    mask = lambda t: fa.text_mask(t.encode(), len(t))
    assert mask(LONG) == 0 and mask(LONG.rsplit(" ", 1)[0]) == 1
    assert mask("") == 1 and mask(" \t\x0b\x0c\r\n") == 1
    assert mask("a b a a") == 1 and mask("a b a a a") == 1 | 2  # exactly half is no failure
    assert mask("Abc" + "é" * 97) == 1 | 0 and mask("ABCD" + "é" * 96) == 1 | 4
    assert mask(LONG + " a|b") == 8
    assert mask("x y   z") == 1  # only ASCII blanks part words


def test_copies_nulls_and_clashing_columns(spark):
    rows = [
        (5, LONG, "en", "x"), (2, LONG, None, "x"), (None, LONG, "en", "x"), (2, LONG, None, "y"),
        (7, None, "de", None), (8, "", "de", None), (9, "B", "de", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string").withColumn(
        "digest", F.lit("clash")
    ).withColumn("n", F.lit("clash")).withColumn("part", F.lit(1))
    flags = fa.with_copies(fa.text_flags(docs, F.col("lang")))
    found = sorted((r.part, r.doc_id or 0, r["mask"], r.n) for r in flags.collect())
    assert found == [("", 2, 0, 2), ("de", 7, 1, 1), ("de", 8, 1 | 16, 1), ("de", 9, 1 | 4, 1), ("en", 0, 0, 1), ("en", 5, 16, 1)]
    empty = fa.text_flags(docs.limit(0), F.col("lang"))
    labels = spark.createDataFrame([(None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.with_copies(empty), labels).count() == 0
    steps = {(r.part, r.filter_order, r.step): r for r in fa.audit(flags, labels).collect()}
    assert len(steps) == 3 * 120 * 5
    first = steps["en", "EABCD", 1]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost) == (1, 1, 0, 1, 0)
    with pytest.raises(ValueError, match="filters"):
        fa.audit(flags, labels, "ABCDEFGHI")
