"""Quality classifier with supervised subword embeddings (operator 9).

Each word (case kept), each character ``ORDER``-gram and each word pair of one word
twice (whichever word) is hashed to one of ``BUCKETS`` learned vectors of ``DIMENSIONS``
numbers. A document is the average of
its features' vectors, followed by a softmax over the two labels. Vectors and
softmax are trained by numpy stochastic gradient descent on at most
``SAMPLE_ROWS`` labelled training documents (whole texts, those of smallest id
hash; half of them of each label where there are enough).

The softmax of an average of vectors needs each vector's product with the softmax
weights only, so what is broadcast for scoring is one number for each bucket and
label: 4 MB, whatever the corpus. Scoring is one pass without a shuffle.

Defined cases: null, empty and blank texts have no features and the score of the
intercepts; without labelled rows every score is 0.5; repeated rows have equal
scores; null ids are scored and never trained on; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import (
    id_remainder,
    list_column,
    mix,
    split_words,
    table,
    texts,
    tidy,
    whole_text,
    word_hashes,
)

ORDER = 3
BUCKETS = 1 << 18
DIMENSIONS = 10
SAMPLE_ROWS = 5_000
EPOCHS, STEP = 8, 1.0


#: Hash of the pair of a word and itself, the same for all words.
TWICE = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Model:
    """score of a bucket for each label, and intercepts."""

    of_bucket: np.ndarray
    bias: np.ndarray


def features(text: str, words: np.ndarray) -> np.ndarray:
    """Buckets of the words, pairs of equal words and character n-grams of a text."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if not len(words):
        return np.empty(0, np.int64)
    n = len(points) - ORDER + 1
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key = key * np.uint64(1_000_003) + points[k : k + n]
    twice = np.full(np.count_nonzero(words[1:] == words[:-1]), TWICE, np.uint64)
    found = np.concatenate([mix(key), mix(words.view(np.uint64)), twice])
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64)


def _rows(docs: DataFrame, kept: list[str], text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        *kept,
        text.cast("binary").alias("_text"),
        word_hashes(split_words(whole_text(text))).alias("_words"),
    )


def _features_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    flat, at = list_column(batch, "_words")
    for i, text in enumerate(texts(batch, "_text")):
        yield features(text, flat[at[i] : at[i + 1]])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """``examples``: label, buckets, and each bucket's share of the features."""
    draw = np.random.Generator(np.random.PCG64(9))
    vectors = draw.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(examples)):
            label, buckets, share = examples[i]
            step = np.float32(STEP * (1 - done / steps))
            done += 1
            average = share @ vectors[buckets]
            logit = average @ softmax + bias
            slope = np.exp(logit - logit.max())
            slope /= slope.sum()
            slope[label] -= 1
            back = softmax @ slope
            softmax -= step * np.outer(average, slope)
            bias -= np.float32(0.01) * step * slope
            # shares are small, so a bucket moves by its share of the root of the size
            vectors[buckets] -= step * np.sqrt(np.float32(len(buckets))) * np.outer(share, back)
    return Model(vectors @ softmax, bias)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """``labels``: doc_id and quality (0 or 1) of the rows to learn from."""
    marked = labels.filter("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").alias(id_col), F.col("quality").cast("int").alias("quality")
    )
    marked = marked.dropDuplicates([id_col])
    order = [F.xxhash64(id_col), F.col(id_col)]
    half = SAMPLE_ROWS // 2
    sample = marked.filter("quality = 0").orderBy(*order).limit(half).unionByName(
        marked.filter("quality = 1").orderBy(*order).limit(half)
    )
    found = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [np.unique(f, return_counts=True) for f in _features_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([b.astype(np.int32).tobytes() for b, _ in counted], pa.binary()),
                    pa.array([n.astype(np.int32).tobytes() for _, n in counted], pa.binary()),
                ],
                ["id", "quality", "buckets", "counts"],
            )

    rows = _rows(found.withColumn("_id", F.col(id_col).cast("string")), ["_id", "quality"], text_col)
    rows = rows.mapInArrow(tidy(run), "id string, quality int, buckets binary, counts binary").toArrow()
    examples = []
    for row in sorted(rows.to_pylist(), key=lambda r: (r["id"], r["quality"], r["buckets"])):
        buckets, n = (np.frombuffer(row[c], np.int32) for c in ("buckets", "counts"))
        if len(buckets):
            examples.append((row["quality"], buckets, (n / n.sum()).astype(np.float32)))
    return train(examples)


def classify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``score`` (probability of label 1) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.of_bucket, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket, bias = shared.value
        apart = (of_bucket[:, 1] - of_bucket[:, 0]).astype(np.float64)
        for batch in batches:
            found = [apart[f].mean() if len(f) else 0.0 for f in _features_of(batch)]
            logit = np.array(found) + float(bias[1] - bias[0])
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [id_col, "score", "predicted"],
            )

    rows = _rows(docs, [id_col], text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_remainder(F.col(doc_id), 3) == 1, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return classify(docs, fit(docs, labels)).withColumn("held_out", held_out())
