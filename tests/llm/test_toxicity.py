"""The block-max search against brute force, held-out labels, and edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from dealgrid.llm import toxicity as x
from dealgrid.llm.toxicity import op12_toxicity

SF = "/root/testdata/sf0.01"


def random_vectors(draw, n, n_terms, most):
    out = []
    for _ in range(n):
        terms = np.sort(draw.choice(n_terms, draw.integers(0, most + 1), replace=False))
        out.append((terms, draw.integers(1, 4, len(terms)).astype(float)))
    return out


@pytest.mark.parametrize(("n", "n_terms", "most"), [(0, 5, 2), (1, 1, 1), (700, 40, 6), (900, 8, 3)])
def test_search_equals_brute_force(n, n_terms, most):
    draw = np.random.default_rng(n)
    idf = draw.uniform(1, 8, n_terms)
    vectors = random_vectors(draw, n, n_terms, most)
    weighted = [(t, x.unit_weights(t, c, idf)) for t, c in vectors]
    index = x.Index.build(weighted, n_terms)
    dense = np.zeros((n, n_terms))
    for row, (t, w) in enumerate(weighted):
        dense[row, t] = w
    for terms, counts in random_vectors(draw, 60, n_terms, most):
        w = x.unit_weights(terms, counts, idf)
        cosine = dense[:, terms] @ w if n else np.empty(0)
        order = np.lexsort((np.arange(n), -np.round(cosine, 9)))
        want = [i for i in order if cosine[i] > 0][:10]
        numbers, cosines = index.search(terms, w, 10)
        assert numbers.tolist() == want
        assert np.allclose(cosines, cosine[want])


def test_terms_count_stems_at_their_levels():
    vocabulary = [b"idiot*1", b"idiot*2", b"scum*1", "réeux".encode() + b"*4"]
    count = x.term_counter(vocabulary)
    assert count("Idiot, idiots! SCUM\n".encode()) == [(0, 2), (1, 1), (2, 1)]
    assert count(("réeuxpa " * 5).encode()) == [(3, 1)]
    assert count(None) == count(b"") == count(b"*** 1*1") == []
    terms = set(x.terms_of({b"ab": 2, b"c": 1}))
    assert terms == {b"ab*1", b"ab*2", b"c*1"}


def test_copies_share_a_family():
    text = " ".join(f"w{i}" for i in range(300)).encode()
    assert x.family(x.words(text)) == x.family(x.words(text.replace(b"w7 ", b"other ")))
    assert x.family(x.words(text)) != x.family(x.words(text[::-1]))
    assert x.family([]) == x.family(x.words(b"!?"))


def test_held_out_documents(spark):
    out = op12_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(out) == docs
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert np.mean([p for p, t in held if not t]) < 0.05
    named = [r for r in out if r.evidence]
    assert named and all(i in labels for r in named for i in r.evidence)
    assert all(s > 0 for r in named for s in r.similarity)


def text(i: int, bad: bool) -> str:
    """No two share four words in a row."""
    words = [f"plain{i * 7 + j}" if j % 3 else f"own{i}x{j}" for j in range(9)]
    return " ".join([*words, *(["scoundrel", "villain"] if bad else [])])


def test_small_tables(spark):
    rows = [(i, text(i, i % 2 == 1), "s") for i in range(40)]
    rows += [(100, None, None), (101, "", None), (None, text(9, True), None), (102, "SCOUNDREL! " * 20_000, None)]
    rows += [(7, text(7, True), "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumnRenamed("score", "terms")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(30)] + [(None, 1), (31, None), (33, 5), (500, 1), (7, 0)], "doc_id long, toxic int"
    )
    out = {(r.doc_id, bool(r.evidence)): r for r in x.classify(docs, labels).collect()}
    assert len(x.classify(docs, labels).collect()) == len(rows)
    assert all(out[i, True].predicted == 1 for i in (31, 39, 102, None))
    assert all(out[i, False].predicted == 0 for i in (30, 100, 101))
    assert out[None, True].score == out[9, True].score
    assert x.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in x.classify(docs, labels.limit(0)).collect()} == {0.0}
    one_class = x.classify(docs, labels.filter("toxic = 1 and doc_id > 10")).collect()
    assert len(one_class) == len(rows) and {r.score for r in one_class} == {1.0}
