"""Toxicity by votes of the nearest labelled examples (operator 12).

Examples are a sample of the labelled documents, at most ``EXAMPLES``, half of each class
where there are more; of copies (see ``family``) the one of the smallest doc_id stays. Terms
are stems (the words of a text, and their first ``STEM_BYTES`` bytes, which inflected forms
share) that occur in it at least once, twice or four times (``OFTEN``). A document's vector has the TF-IDF weights (1 + log tf) * (1 + log((1 + n) / (1 + df)))
of its feature terms, scaled to length 1; tf and df are counts in the whole text and over all
documents. Feature terms are those of ``LEAST_EXAMPLES`` examples or more, a share of
``LEAST_TOXIC`` of them toxic, whose presence differs between the classes by a chi-squared of
``LEAST_CHI`` (at most ``FEATURES``): terms that texts draw at random would else drown the few
that decide.

Block-max index: examples are numbered so that similar vectors are neighbours, and cut into
blocks of ``BLOCK`` numbers. A term's postings (example, weight) are kept with the largest
weight in each block. A search adds up these maxima to an upper bound per block, visits blocks
by falling bound, scores their postings in full, and ends when the next bound is below the
``NEIGHBOURS``-th best cosine found. So the result is exact; ties go to the smaller number.

A neighbour at cosine c votes with weight 1 / (``NEAR`` + sqrt(2 - 2c)). The share of the
toxic votes is turned into a probability by a logistic curve, fitted to the votes that each
example gets from the others; texts without feature terms get the examples' rate of those.
Both are moved to the classes' shares among all labelled documents.

Distribution: sample and index are bounded by ``EXAMPLES`` and ``FEATURES``, whatever the
corpus, and broadcast. Texts are read once more, by a job that leaves the sparse counts of
feature terms; document frequencies are summed from these, and searches read only them.

Defined cases: null or empty text, and one without feature terms, has no neighbours; null or
repeated ids are scored like others; a doc_id labelled several times is toxic if any row says
so; labels other than 0 and 1 and
rows of documents that do not exist are left out; without examples every score is 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import id_remainder, received, sent, table, tidy, whole_text
from dealgrid.plans.sizing import materialize

EXAMPLES = 20_000
FEATURES, LEAST_CHI, LEAST_EXAMPLES, LEAST_TOXIC = 1_024, 25.0, 3, 0.6
STEM_BYTES, OFTEN = (5, 6, 7, 8), (1, 2, 4)
FAMILY_WORDS = 4
NEIGHBOURS, BLOCK, BLOCKS_AT_ONCE = 8, 64, 8
NEAR = 0.1
EVIDENCE = 5
#: Pull of the examples' toxic share on a vote, as the weight of one voter.
PULL = 0.5
#: Words and vectors that a worker remembers.
MEMO_ENTRIES = 50_000
#: Slack for sums of floats in another order.
SLACK = 1e-9

#: Bytes of words, lower-cased; every other byte parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(WORD_BYTES).split()


def stems(word: bytes) -> list[bytes]:
    """The word, and its first bytes."""
    return [word, *[word[:n] for n in STEM_BYTES if n < len(word)]]


def terms_of(counts: dict[bytes, int]) -> Iterator[bytes]:
    """The terms of a text, from the counts of its stems."""
    for stem, n in counts.items():
        yield from (b"%b*%d" % (stem, least) for least in OFTEN if n >= least)


def term_counter(vocabulary: list[bytes]) -> Callable[[bytes | None], list[tuple[int, int]]]:
    """text -> numbers, rising, and counts of the vocabulary's terms in it."""
    levels: dict[bytes, list[tuple[int, int]]] = {}
    for number, term in enumerate(vocabulary):
        stem, least = term.split(b"*")
        levels.setdefault(stem, []).append((int(least), number))
    memo: dict[bytes, tuple[bytes, ...]] = {}

    def look_up(word: bytes) -> tuple[bytes, ...]:
        found = memo.get(word)
        if found is None:
            found = tuple(stem for stem in stems(word) if stem in levels)
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[word] = found
        return found

    def count(raw: bytes | None) -> list[tuple[int, int]]:
        counts = Counter(stem for found in map(look_up, words(raw)) if found for stem in found)
        return sorted((k, n // least) for stem, n in counts.items() for least, k in levels[stem] if n >= least)

    return count


# --- examples and their feature terms ----------------------------------------------------


def class_counts(labels: DataFrame) -> tuple[DataFrame, int, int]:
    """``doc_id, toxic`` once a document, and the documents of both classes."""
    marked = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    return marked, counts.get(0, 0), counts.get(1, 0)


def examples_of(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``example_id, toxic, text`` of the sampled texts, one of each family."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    halves = [marked.filter(F.col("toxic") == c).orderBy(*order).limit(EXAMPLES // 2) for c in (0, 1)]
    sample = halves[0].unionByName(halves[1]).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(F.col(text_col)).cast("binary").alias("text"))
    found = rows.join(F.broadcast(sample), "_id").select(F.col("_id").cast("long").alias("example_id"), "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families = [family(words(text.as_py())) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(families, pa.binary()), *batch.columns], ["family", *batch.schema.names]
            )

    fields = "family binary, example_id long, toxic int, text binary"
    merged = found.mapInArrow(tidy(run), fields).groupBy("family").agg(
        F.min(F.struct("example_id", "toxic", "text")).alias("example")
    )
    return materialize(merged.select("example.*"), "toxic_examples")


def family(parts: list[bytes]) -> bytes:
    """Of a text's runs of ``FAMILY_WORDS`` words the one of the smallest checksum (all its
    words, if they are fewer). Texts that share nearly all runs nearly always share it."""
    runs = [b" ".join(parts[i : i + FAMILY_WORDS]) for i in range(max(1, len(parts) - FAMILY_WORDS + 1))]
    return hashlib.sha256(min(runs, key=lambda run: (zlib.crc32(run), run))).digest()


def feature_terms(examples: DataFrame, features: int = FEATURES) -> list[bytes]:
    """The terms that tell the classes apart, most telling first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(terms_of(Counter(x for word in words(text.as_py()) for x in stems(word))))
            own = list(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary())] + [pa.array([c[w] for w in own], pa.int64()) for c in counts],
                ["term", "clean", "toxic"],
            )

    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []
    found = examples.select("text", "toxic").mapInArrow(tidy(run), "term binary, clean long, toxic long")
    a, b = F.sum("toxic").cast("double"), F.sum("clean").cast("double")
    with_term, without = a + b, F.lit(float(n0 + n1)) - (a + b)
    cross = a * n0 - b * n1
    chi = (n0 + n1) * cross * cross / (with_term * without * float(n0) * float(n1))
    telling = (without > 0) & (with_term >= LEAST_EXAMPLES) & (a >= LEAST_TOXIC * with_term)
    scored = found.groupBy("term").agg(F.when(telling, chi).alias("chi"))
    top = scored.filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(features)
    return [bytes(r["term"]) for r in top.collect()]


def sparse_counts(rows: DataFrame, vocabulary: list[bytes], text_col: str) -> DataFrame:
    """The columns of ``rows`` but the text, with ``terms`` (numbers in ``vocabulary``, rising)
    and ``counts``."""
    kept = [c for c in rows.columns if c != text_col]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = term_counter(shared.value)
        for batch in batches:
            found = [count(text.as_py()) for text in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array([[x[i] for x in row] for row in found], pa.list_(pa.int32())) for i in (0, 1)],
                [*kept, "terms", "counts"],
            )

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(tidy(run), f"{fields}, terms array<int>, counts array<int>")


# --- the index ---------------------------------------------------------------------------


def unit_weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0] .. stop[0] - 1, start[1] .. stop[1] - 1, ..."""
    sizes = stop - start
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)


@dataclass
class Index:
    """Postings by term and example; an *entry* is a term's part of them in one block.
    ``entries[t]`` to ``entries[t + 1]`` are the entries of term t, ``postings[e]`` to
    ``postings[e + 1]`` the postings of entry e."""

    n: int
    entries: np.ndarray
    block: np.ndarray
    most: np.ndarray
    postings: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        """``vectors``: terms and weights of each example, by number."""
        sizes = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        example = np.repeat(np.arange(len(vectors)), sizes)
        order = np.lexsort((example, term))
        term, weight, example = term[order], weight[order], example[order]
        blocks = max(1, -(-len(vectors) // BLOCK))
        key = term * blocks + example // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        most = np.maximum.reduceat(weight, first) if len(first) else np.empty(0)
        return cls(
            len(vectors),
            np.searchsorted(key[first] // blocks, np.arange(n_terms + 1)),
            key[first] % blocks,
            most,
            np.r_[first, len(key)],
            example,
            weight,
        )

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples of positive cosine."""
        start, stop = self.entries[terms], self.entries[terms + 1]
        entry = _ranges(start, stop)
        own_weight = np.repeat(weights, stop - start)
        block = self.block[entry]
        bound = np.bincount(block, own_weight * self.most[entry], -(-self.n // BLOCK))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        numbers, cosines = np.empty(0, np.int64), np.empty(0)
        for i in range(0, len(order), BLOCKS_AT_ONCE):
            if len(cosines) >= k and bound[order[i]] < cosines[k - 1] - SLACK:
                break
            visited = np.zeros(len(bound), bool)
            visited[order[i : i + BLOCKS_AT_ONCE]] = True
            inside = visited[block]
            first, last = self.postings[entry[inside]], self.postings[entry[inside] + 1]
            posting = _ranges(first, last)
            parts = self.weight[posting] * np.repeat(own_weight[inside], last - first)
            number, slot = np.unique(self.example[posting], return_inverse=True)
            numbers = np.concatenate([numbers, number])
            cosines = np.concatenate([cosines, np.bincount(slot, parts, len(number))])
            best = np.lexsort((numbers, -np.round(cosines, 9)))[:k]
            numbers, cosines = numbers[best], cosines[best]
        return numbers, cosines


# --- votes -------------------------------------------------------------------------------


@dataclass
class Model:
    vocabulary: list[bytes]
    idf: np.ndarray
    index: Index
    toxic: np.ndarray
    ids: np.ndarray
    share: float
    slope: float
    offset: float
    without: float

    def neighbours(self, terms: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.index.search(terms, unit_weights(terms, counts, self.idf), k)

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (NEAR + np.sqrt(np.maximum(0, 2 - 2 * cosines)))
        return float(((w * self.toxic[numbers]).sum() + PULL * self.share) / (w.sum() + PULL))

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * _logit(vote) + self.offset)))


def _logit(p: float | np.ndarray) -> float | np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and offset of the curve through (x, y), by Newton's method."""
    beta = np.array([1.0, 0.0])
    rows = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (p - y) + ridge * (beta - [1, 0])
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def _own_votes(spark: SparkSession, shared: Broadcast, vectors: Broadcast, n: int) -> np.ndarray:
    """What the other examples vote for each example (NaN: no neighbour), by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, examples = received(shared), received(vectors)
        for batch in batches:
            own = batch.column("id").to_numpy()
            votes = []
            for number in own:
                terms, counts = examples[number]
                found, cosines = model.neighbours(terms, counts, NEIGHBOURS + 1)
                other = np.flatnonzero(found != number)[:NEIGHBOURS]
                votes.append(model.vote(found[other], cosines[other]) if len(other) else math.nan)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(votes, pa.float64())], ["id", "vote"])

    parts = max(1, min(spark.sparkContext.defaultParallelism, n // 100 + 1))
    rows = spark.range(0, n, 1, parts).mapInArrow(tidy(run), "id long, vote double").toArrow()
    out = np.full(n, math.nan)
    out[rows.column("id").to_numpy()] = rows.column("vote").to_numpy()
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """The model, and the sparse counts of all ``docs`` (``id_col, terms, counts``)."""
    spark = docs.sparkSession
    marked, n_clean, n_toxic = class_counts(labels)
    examples = examples_of(docs, materialize(marked, "toxic_labels"), id_col, text_col)
    vocabulary = feature_terms(examples)
    rows = docs.select(F.col(id_col), whole_text(F.col(text_col)).cast("binary").alias("_text"))
    counted = materialize(sparse_counts(rows, vocabulary, "_text"), "feature_counts")

    frequency = np.zeros(len(vocabulary))
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for row in found.collect():  # one row a feature term
        frequency[row["term"]] = row["count"]
    idf = 1 + np.log((1 + counted.count()) / (1 + frequency))

    own = sparse_counts(examples, vocabulary, "text").toArrow().to_pylist()
    own.sort(key=lambda r: (r["terms"], r["counts"], r["toxic"], r["example_id"]))
    vectors = [(np.array(r["terms"], np.int64), np.array(r["counts"], np.float64)) for r in own]
    toxic = np.array([r["toxic"] for r in own], np.float64)
    index = Index.build([(t, unit_weights(t, c, idf)) for t, c in vectors], len(vocabulary))
    ids = np.array([r["example_id"] for r in own], np.int64)
    share = float(toxic.mean()) if len(toxic) else 0.0
    model = Model(vocabulary, idf, index, toxic, ids, share, 1.0, 0.0, share)
    if 0 < share < 1:
        # from the sample's odds of the classes to those of all labelled documents
        move = float(_logit(n_toxic / (n_toxic + n_clean)) - _logit(share))
        bare = toxic[[not len(t) for t, _ in vectors]]
        rate = (bare.sum() + PULL * share) / (len(bare) + PULL)
        model.without = 1 / (1 + math.exp(-(_logit(rate) + move)))
        shared, broad = sent(spark, model), sent(spark, vectors)
        votes = _own_votes(spark, shared, broad, len(own))
        broad.destroy()
        shared.destroy()
        known = ~np.isnan(votes)
        if len(set(toxic[known])) == 2:
            model.slope, model.offset = logistic_curve(_logit(votes[known]), toxic[known])
        model.offset += move
    return model, counted


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (probability of label 1), ``predicted``, ``evidence`` (doc_ids
    of the nearest examples) and ``similarity`` (their cosines) of every row."""
    model, counted = learn(docs, labels, id_col, text_col)
    shared = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = remembering(received(shared))
        for batch in batches:
            vectors = zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            found = [judge(tuple(t), tuple(c)) for t, c in vectors]
            scores = np.array([f[0] for f in found], np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                [id_col, "score", "predicted", "evidence", "similarity"],
            )

    kind = counted.schema[id_col].dataType.simpleString()
    return counted.mapInArrow(
        tidy(run), f"`{id_col}` {kind}, score double, predicted int, evidence array<long>, similarity array<double>"
    )


def remembering(model: Model) -> Callable[[tuple, tuple], tuple[float, list[int], list[float]]]:
    """Score and evidence of a vector; equal vectors are searched for once a while."""
    memo: dict[tuple, tuple[float, list[int], list[float]]] = {}

    def judge(terms: tuple, counts: tuple) -> tuple[float, list[int], list[float]]:
        key = (terms, counts)
        if key not in memo:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            numbers, cosines = model.neighbours(np.array(terms, np.int64), np.array(counts, np.float64), NEIGHBOURS)
            if len(numbers):
                near = slice(0, EVIDENCE)
                score = model.score(model.vote(numbers, cosines))
                memo[key] = (score, model.ids[numbers[near]].tolist(), cosines[near].tolist())
            else:
                memo[key] = (model.without, [], [])
        return memo[key]

    return judge


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_remainder(F.col(doc_id), 5) == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    return classify(docs, labels).withColumn("held_out", held_out())
