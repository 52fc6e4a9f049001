"""Learned operators on whole tables: held-out labels, and brute force in Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dealgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_of_held_out_documents(spark, docs):
    out = QUERIES["op5_language_id"](spark, SF).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in out)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


def test_quality_of_held_out_documents(spark, docs, labels):
    out = QUERIES["op9_quality_classifier"](spark, SF).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in held]) > 0.9


def test_mixing_leaves_toxic_documents_out(spark, docs, labels):
    out = {r.doc_id: r for r in QUERIES["op6_mixing"](spark, SF).collect()}
    assert set(out) == set(docs)
    toxic = [out[i].copies for i, x in labels.items() if x.toxic]
    clean = [out[i].copies for i, x in labels.items() if x.quality and not x.toxic]
    assert np.mean(toxic) < 0.1 and np.mean([c > 0 for c in clean]) > 0.97


def test_lm_base_score_by_brute_force(spark, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: WORDS.findall((d.text or "").translate(lower)) + [None] for i, d in docs.items()}
    seen, pairs = Counter(), Counter()
    for i, t in tokens.items():
        if remainder(i, 7) != 2:
            seen.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(seen.values()), len(seen)
    middle = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0
    apart = []
    for r in QUERIES["op7_lm_score"](spark, SF).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in seen for w in t), n)
        assert r.held_out == (remainder(r.doc_id, 7) == 2)
        assert np.isclose(r.base_score, sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in t))
        exact = 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            c, one, two = middle(seen[a]), middle(seen[b]), middle(pairs[a, b])
            exact += np.log10(0.4 * two / max(c, two, 1) + 0.6 * (one + 1) / (n + v + 1))
        apart.append((r.score - exact) / len(t))
    assert abs(np.median(apart)) < 0.02  # the filter's false positives


def test_quality_rule_statistics_by_brute_force(spark, docs):
    out = QUERIES["op10_quality_rules"](spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        text = docs[r.doc_id].text or ""
        words = WORDS.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_robust_estimates_by_brute_force(spark):
    from dealgrid.llm import outliers

    draw = np.random.Generator(np.random.PCG64(7))
    x = draw.multivariate_normal([0, 1, 5], [[1, 0.3, 0], [0.3, 2, 0.5], [0, 0.5, 1]], 2000)
    x[:300] += [30, -20, 10]  # planted outliers
    rows = spark.createDataFrame(
        [("en", "a", i, *map(float, v)) for i, v in enumerate(x)],
        "lang string, source string, doc long, x0 double, x1 double, x2 double",
    )
    row = outliers.estimates(rows).first()
    centre = np.array([row.m0, row.m1, row.m2])
    assert np.abs(centre - x[300:].mean(axis=0)).max() < 0.1
    # a further concentration step by numpy keeps what was found
    cov = np.array([[row.c00, row.c01, row.c02], [row.c01, row.c11, row.c12], [row.c02, row.c12, row.c22]])
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    near = x[np.argsort(d)[: int(0.75 * len(x))]]
    assert np.abs(near.mean(axis=0) - centre).max() < 0.1
    assert (d[:300] > outliers.LIMIT).all() and (d[300:] < outliers.LIMIT).mean() > 0.99


def test_language_stage_rejects_planted_documents(spark, docs):
    """Of mixtures, those in which no language holds the least share go; so do texts
    without a letter. Texts in one language or two halves stay."""
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    by_lang = {}
    for d in docs.values():
        if d.lang and d.text and len(d.text) > 2_000:
            by_lang.setdefault(d.lang, []).append(d.text[:2_000])
    langs = sorted(by_lang)
    assert len(langs) >= 4
    one = [by_lang[lang][0] for lang in langs]
    go = [None, "", "12345 ### 99\n--", "\n".join(one), "\n".join(reversed(one))]
    stay = [*one, one[0] + "\n" + one[1], one[2] + "\n" + one[3]]
    rows = [(10**9 + i, t, None, "planted", None) for i, t in enumerate(go)]
    rows += [(2 * 10**9 + i, t, None, "planted", None) for i, t in enumerate(stay)]
    planted = spark.createDataFrame(rows, source.schema)
    out = corpus_pipeline.language_id(spark, source.unionByName(planted), SF)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert not kept & {r[0] for r in rows[: len(go)]}
    assert {r[0] for r in rows[len(go) :]} <= kept
    clean = {i for i, d in docs.items() if d.lang and d.text and any(c.isalpha() for c in d.text)}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_pipeline(spark, docs, labels):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    source = spark.read.parquet(f"{SF}/documents.parquet")
    found, last = source, len(corpus_pipeline.STAGES) - 1
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = corpus_pipeline.materialize(stage(spark, found, SF))
        if k < last:
            assert found.columns == source.columns
    out = found.collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and all(r.n_tokens * 4 == len(r.tokens) for r in out)
    texts = Counter(d.text for d in docs.values())
    alone = {i for i, d in docs.items() if texts[d.text] == 1}
    clean = [i for i, x in labels.items() if x.quality and not x.toxic and i in alone]
    assert np.mean([i in set(ids) for i in clean]) > 0.9
    assert not set(ids) & {i for i, x in labels.items() if x.toxic} or np.mean(
        [i in set(ids) for i, x in labels.items() if x.toxic]
    ) < 0.1
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in out)
