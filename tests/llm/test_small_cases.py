"""Nulls, empty texts and tables, ties, repeated rows and clashing column names."""

from __future__ import annotations

import math

import pytest

from dealgrid.llm import knn, langid, license_scan, line_dedup, lm, minhash, mixing, outliers, quality

TEXTS = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t ", "en", None),
    (4, "One two. All rights reserved, x", "en", "a"),
    (4, "One two. All rights reserved, x", "en", "a"),
    (None, "Drei vier fünf", "de", "b"),
    (5, "word " * 30_000, "en", "b"),
    (6, "### $$$ !!!", None, None),
]
#: Names that the operators use inside.
CLASHES = "h string, words string, text_hash string, score string, kept string, n_words string, train string, bucket string, doc string, body string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("x",) * 10
    return spark.createDataFrame(
        [row + extra for row in TEXTS], f"doc_id long, text string, lang string, source string, {CLASHES}"
    ).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (6, 0, 0), (5, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )


def test_license_scan(docs):
    out = license_scan.scan(docs).collect()
    assert len(out) == len(TEXTS)
    row = next(r for r in out if r.doc_id == 4)
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (6, 1, 2, 2)
    assert (row.base_labels, row.labels, row.score) == ("reserved", "reserved", 1.0)
    empty = next(r for r in out if r.doc_id == 1)
    assert (empty.n_words, empty.n_base, empty.first_word, empty.labels, empty.score) == (0, 0, None, "", 0.0)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_containment_at_the_threshold(spark):
    # five words: four of them, in any order, reach 0.8; three do not
    rows = [(1, "delta x alpha\nbeta gamma"), (2, "delta beta alpha, gamma!"), (3, "alpha beta gamma zeta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.template_matches(docs, {"own": ("alpha beta gamma delta epsilon",)}, 0.8).collect()
    assert [(r.doc_id, r.block, r.label, r.containment) for r in found] == [(2, 0, "own", 0.8)]


def test_line_dedup(spark):
    a, b, c = "a " * 30, "b " * 25, "short line"
    rows = [
        (2, f"{a}\n{b}\n{c}", 0),
        (1, f"{a}\n\n{b}\nown", 0),
        (3, f"{c}\n{a}", 0),
        (4, None, 0),
        (5, "", 0),
        (6, "\n".join(["same " * 60] * 3), 0),
        (1, f"{a}\n\n{b}\nown", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hashes int")
    out = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert out[1].text == rows[1][1] and out[1]._gone == 0
    assert out[2].text == c and out[2]._gone == 2
    assert out[3].text == rows[2][1]  # 30 words alone are no run
    assert out[4].text is None and out[5].text == ""
    assert out[6].text == "same " * 60 and out[6]._gone == 2
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def test_winnowing_keeps_a_fingerprint_in_every_window():
    words = [7, 20, 3, 60, 1, 1, 1, 49, 50, 2]
    hashes = [5, 3, 3, 9, 1, 1, 8, 2, 7, 0]
    picked = line_dedup.winnow(hashes, words, 50)
    for start, end in line_dedup.windows(words, 50):
        assert any(start <= p <= end for p in picked)


def test_minhash(spark):
    base = [f"w{i}" for i in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    far = base[:250] + [f"v{i}" for i in range(150)]
    rows = [(7, " ".join(base)), (3, " ".join(near)), (5, " ".join(far)), (9, " ".join(base).upper())]
    rows += [(1, None), (2, "  "), (4, "two words"), (8, "two words"), (None, "two words"), (9, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles): r for r in minhash.link(docs, 4, 80).collect()}
    assert {k[0]: (r.component_id, r.kept) for k, r in out.items()} == {
        7: (3, False), 3: (3, True), 9: (3, False), 5: (5, True), 1: (1, True), 2: (2, True),
        4: (4, True), 8: (4, False), None: (None, True),
    }
    assert out[(4, 1)].n_shingles == 1 and out[(7, 397)].n_shingles == 397
    assert minhash.link(docs.limit(0), 4, 80).count() == 0


def test_minhash_ids_with_several_texts(spark):
    """Versions of one id: what is linked with one of them is linked with all, in any row
    order, also where the id is not the smallest of its copies; repeated rows change nothing."""
    a, b = [" ".join(f"{c}{i}" for i in range(100)) for c in "ab"]
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (1, b)]
    rows += [(20, "p q r s t"), (27, "p q r s t"), (27, "u v w x y"), (23, "u v w x y"), (28, "other")]
    want = {1: 1, 2: 1, 3: 1, 20: 20, 27: 20, 23: 20, 28: 28}
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        out = minhash.link(docs, 4, 80).collect()
        assert len(out) == len(rows)
        assert {(r.doc_id, r.component_id) for r in out} == set(want.items())
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_chains_need_every_link(spark):
    """A chain of near copies, each like its neighbours only, and more members than
    a block holds."""
    rows = []
    for k in range(60):
        words = [f"c{i}" for i in range(k * 12, k * 12 + 160)]
        rows.append((1000 - k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.link(docs, 4, 80).collect()
    assert {r.component_id for r in out} == {941}


def test_groups_in_parts_and_by_bucket_give_the_same_components(spark, monkeypatch):
    import random

    draw = random.Random(11)
    rows, base = [], [f"b{i}" for i in range(200)]
    for k in range(40):
        words = list(base)
        for _ in range(draw.choice([1, 2, 5, 8, 12, 30])):
            words[draw.randrange(200)] = f"x{k}-{draw.random()}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(197)} for k, t in rows}
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    label[a] = label[b] = min(label[a], label[b])
    found = lambda: {r.doc_id: r.component_id for r in minhash.link(docs, 4, 80).collect()}
    assert found() == label and len(set(label.values())) > 3
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert found() == label
    monkeypatch.setattr(minhash, "MOST_FAMILY", 5)
    assert found() == label


def test_estimate_is_near_the_similarity():
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(1))
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[400:2400]
    found = minhash.similarity(*(np.frombuffer(minhash.pack(minhash.minima(x)), np.uint8) for x in (a, b)))
    assert abs(found - 1600 / 2400) < 0.2


def test_language_id(docs):
    model = langid.learn(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out}
    for i in (1, 2, 3, 6):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].languages) == ("und", 0.0, [])
    assert by_id[None].lang_pred == "de" and by_id[4].lang_pred in ("de", "en")
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_mixture_finds_both(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang in ('en', 'fr')")
    model = langid.learn(sf)
    long = {r.lang: r.text for r in sf.filter("length(text) between 1500 and 4000").collect()}
    both = long["en"][:1400] + "\n" + long["fr"][:700]
    found = langid.mixture(model, langid.ngrams(both, langid.letters()))
    assert [lang for lang, _ in found] == ["en", "fr"] and 0.55 < found[0][1] < 0.8
    assert len(langid.mixture(model, langid.ngrams(long["en"], langid.letters()))) == 1


def test_lm(docs):
    from pyspark.sql import functions as F

    out = lm.score(docs, F.lit(True)).collect()
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].n_tokens == 1 and by_id[4].n_tokens == 7 and by_id[5].n_tokens == 30_001
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) and r.score <= 0 for r in out)
    unseen = lm.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in unseen)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_filter_never_loses_a_count():
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(2))
    key = draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    n = draw.integers(1, 5000, 4000)
    level = lm.levels_of(n)
    own = [lm.segment_of(key, 3) == s for s in range(3)]
    parts = [lm.insert(key[o], level[o], 1e9) for o in own]
    bloom = lm.Filter(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    assert (bloom.levels(key) >= level).all()
    assert (bloom.levels(key + np.uint64(1)) > 0).mean() < 0.06
    assert (lm.count_at(level) >= n / 2).all() and (lm.count_at(level) <= n * 1.5).all()


def test_rare_words_meet_the_vocabulary_in_a_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect()}
    monkeypatch.setattr(lm, "HEAD_WORDS", 20)
    for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect():
        assert r.n_known == whole[r.doc_id].n_known
        assert math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-12)


def test_lm_score_in_several_passes(spark, monkeypatch):
    """A filter that is larger than a broadcast may be keeps its bits and scores."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "SEGMENT_NGRAMS", 5_000)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score)
    found = lambda: sorted(lm.score(docs, F.col("doc_id") % 3 != 0).collect(), key=key)
    whole = found()
    monkeypatch.setattr(lm, "MOST_BYTES", 20_000)
    for a, b in zip(whole, found(), strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert math.isclose(a.score, b.score, rel_tol=1e-12)
    assert lm.passes([5, 0, 4, 9, 20, 1], 9) == [(0, 3), (3, 4), (4, 5), (5, 6)]


def test_quality(docs, labels):
    out = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out}
    assert by_id[4].score > by_id[6].score
    assert by_id[1].score == by_id[2].score == by_id[3].score
    untrained = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs.filter("doc_id = 1"), untrained).collect()} == {0.5}


def test_mixing(docs, labels):
    out = mixing.mix_documents(docs, labels).collect()
    assert len(out) == len(TEXTS)
    assert all(abs(sum(r.posterior) - 1) < 1e-5 and r.rate >= 0 and r.copies >= 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix_documents(docs.limit(0), labels).count() == 0
    assert mixing.mix_documents(docs, labels.limit(0)).count() == len(TEXTS)


def test_mixing_meets_targets(spark):
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(5))
    p = draw.dirichlet([0.5, 0.3, 0.2], 500)
    n = draw.integers(10, 900, 500)
    members = spark.createDataFrame(
        [(i, int(n[i]), p[i].tolist()) for i in range(500)], "doc_id long, n_tokens long, posterior array<double>"
    )
    weights = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    mix = mixing.solve(members, weights, budget=float(n.sum()))
    assert np.abs(mix.totals - mix.targets).max() < 0.005 * n.sum()
    rows = mixing.apply(members, mix).orderBy("doc_id").toPandas()
    assert np.allclose((rows["n_tokens"] * rows["rate"]).to_numpy() @ p, mix.totals)
    # against many plain steps of the same objective, by brute force
    r, t, scale = np.ones(500), mix.targets, n.sum()
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ ((n * r) @ p - t) / scale + mix.keep * (r - 1)) / (1 + mix.keep))
    value = lambda x: ((((n * x) @ p - t) / scale) ** 2).sum() / 2 + mix.keep / 2 * (n / scale * (x - 1) ** 2).sum()
    assert value(rows["rate"].to_numpy()) <= value(r) + 1e-5


@pytest.mark.parametrize("weights", [(0.97, 0.03, 0.0), (0.2, 0.3, 0.5)])
def test_mixing_against_plain_descent(spark, weights):
    """The operator's own objective (residuals by supply), many plain projected steps; many
    rates end at 0."""
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(7))
    kind = draw.choice(3, 400, p=[0.8, 0.15, 0.05])
    z = draw.normal(0, 1.5, (400, 3))
    z[np.arange(400), kind] += draw.uniform(1, 8, 400)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n = draw.integers(0, 900, 400)
    members = spark.createDataFrame(
        [(i, int(n[i]), p[i].tolist()) for i in range(400)], "doc_id long, n_tokens long, posterior array<double>"
    )
    keep = 0.01
    mix = mixing.solve(members, dict(zip(mixing.DOMAINS, weights, strict=True)), keep=keep)
    r, supply = np.ones(400), n @ p
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ (((n * r) @ p - mix.targets) / supply) + keep * (r - 1)) / (1 + keep))
    rows = mixing.apply(members, mix).orderBy("doc_id").toPandas()
    apart = rows["rate"].to_numpy() - r
    assert (r == 0).sum() > 5 and n @ apart**2 <= (2 * mixing.RATE_ERROR) ** 2 * n.sum()
    assert np.allclose((n * r) @ p, mix.totals, atol=1e-3 * n.sum())
    assert mix.jobs < 30


def test_mixing_raises_instead_of_ending_early(spark, monkeypatch):
    members = spark.createDataFrame(
        [(1, 100, [0.9, 0.05, 0.05]), (2, 900, [0.1, 0.1, 0.8])], "doc_id long, n_tokens long, posterior array<double>"
    )
    monkeypatch.setattr(mixing, "JOBS", 1)
    with pytest.raises(RuntimeError, match="not fitted"):
        mixing.solve(members)


@pytest.mark.parametrize("rare", [1, 10])
def test_mixing_leaves_a_rare_domain_out(spark, rare):
    """Toxic text of 0.1 % or 1 % of the tokens, target 0; low quality 10 %, target 3 %."""
    import numpy as np

    kinds = ["toxic"] * rare + ["low"] * 100 + ["high"] * (900 - rare)
    soft = {"high": [0.999, 0.00099, 1e-5], "low": [0.001, 0.99899, 1e-5], "toxic": [0.0005, 0.0005, 0.999]}
    members = spark.createDataFrame(
        [(i, 100, soft[k]) for i, k in enumerate(kinds)], "doc_id long, n_tokens long, posterior array<double>"
    )
    mix = mixing.solve(members)
    rows = mixing.apply(members, mix).orderBy("doc_id").toPandas()
    rate = {k: rows["rate"][np.array(kinds) == k].mean() for k in soft}
    assert rate["toxic"] < 0.02
    assert np.allclose(mix.totals[:2], mix.targets[:2], rtol=0.005)


def test_outliers(docs):
    out = outliers.judge(docs).collect()
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out}
    assert (by_id[1].n_words, by_id[1].word_chars, by_id[1].base_failed, by_id[1].kept) == (0, 0, True, False)
    assert by_id[5].n_repeat_words == 30_000 and by_id[5].base_failed
    assert by_id[6].n_symbols == 6
    assert outliers.judge(docs.limit(0)).count() == 0


def test_outlier_found_in_its_group(spark):
    rows = [(i, f"plain words of about the usual length stand here again number {i} " * 1 + "and some more of them " * (i % 2), "en", "a") for i in range(80)]
    rows += [(900, "what### is### this### stuff$$$ with&&& so*** many%%% signs### in### it### now###", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.kept for r in outliers.judge(docs).collect()}
    assert not out.pop(900) and all(out.values())


def test_shuffled_repeated_lines_are_an_outlier(spark):
    """Half of the short lines repeat, but hardly a window of five words."""
    import random

    draw = random.Random(3)
    lines = [" ".join(f"w{draw.randrange(9000)}" for _ in range(3)) for _ in range(60)] * 2
    draw.shuffle(lines)
    rows = [(i, "\n".join(" ".join(f"w{draw.randrange(9000)}" for _ in range(3)) for _ in range(80)), "en", "a") for i in range(80)]
    rows += [(900, "\n".join(lines), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert not out[900].base_failed and not out.pop(900).kept
    assert all(r.kept for r in out.values())


def test_estimates_of_a_group_with_forty_percent_outliers(spark):
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(8))
    x = draw.multivariate_normal([0, 1, 5], [[1, 0.3, 0], [0.3, 2, 0.5], [0, 0.5, 1]], 2000)
    x[:800] += [30, -20, 10]
    rows = spark.createDataFrame(
        [("en", "a", i, *map(float, v)) for i, v in enumerate(x)],
        "lang string, source string, doc long, x0 double, x1 double, x2 double",
    )
    found = outliers.estimates(rows)
    distance = outliers._with_estimates(rows, found).withColumn("d", outliers._distance()).orderBy("doc").toPandas()["d"]
    assert (distance[:800] > outliers.LIMIT).all() and (distance[800:] < outliers.LIMIT).mean() > 0.99
    row = found.first()
    assert np.abs(np.array([row.m0, row.m1, row.m2]) - x[800:].mean(axis=0)).max() < 0.2


def test_top_k(spark):
    rows = [
        (100, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.1], 0), (3, None, 0), (4, [float("nan"), 1.0], 0),
        (5, [None, 1.0], 0), (None, [1.0, 1.0], 0), (6, [-1.0, 3.0], 0), (7, [1.0], 0), (8, [0.5, 0.5], 0), (8, [0.5, 0.5], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    vectors = knn.whole_numbers(table, 1024, "vec_id", "embedding")
    found = knn.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 4).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(100, 1, 1), (100, 2, 2), (100, 3, 8), (100, 4, 8)]
    assert found[0].score == 1024 * 512
    none = table.limit(0)
    vectors = knn.whole_numbers(none, 1024, "vec_id", "embedding")
    assert knn.top_k(vectors, vectors, 4).count() == 0


def test_top_k_over_shards_and_blocks(spark):
    import numpy as np

    vectors = knn.whole_numbers(
        spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), 1024, "vec_id", "embedding"
    )
    queries = vectors.filter("vec_id % 20 = 0")
    found = knn.top_k(vectors, queries, 5, shard_rows=70, block_queries=9).orderBy("query_id", "rank").collect()
    rows = vectors.orderBy("vec_id").toPandas()
    x, ids = np.array(rows["vector"].tolist()), rows["vec_id"].to_numpy()
    expected = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        expected += [(ids[i], k + 1, ids[j], scores[j]) for k, j in enumerate(order)]
    assert [tuple(r) for r in found] == [tuple(map(int, e)) for e in expected]
