"""Language identification by mixture inference (operator 5).

Learning: hashed character n-grams (``ORDERS``) of the training documents are
counted per language over all of them, in numpy inside tasks and by a Spark
aggregation across tasks. The model is languages x ``BUCKETS`` smoothed
probabilities: bounded by the number of distinct ``lang`` values, not by the
corpus, so it may be collected and broadcast.

Prediction: a document's n-grams are drawn from a mixture of languages. Its
proportions are estimated by expectation-maximisation; then nested sets of the
largest shares are compared by penalised likelihood (half the log of the
number of n-grams for each language after the first), and the best set's
proportions are the result.
The languages' n-grams overlap, so the likelihood counts 1/len(text n-grams per
letter). The largest share names the language; the share is the score.

Defined cases: null text or text without a letter: ``und``, score 0, no
languages; ties take the alphabetically first language; without training
documents everything is ``und``; null ids are kept, and count as training rows
only if the caller's filter says so; repeated rows repeat; only id, text and
(for learning) lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import decoded, id_remainder, mix, table, texts, tidy

ORDERS = (1, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS, TOLERANCE = 25, 1e-4
#: Shares below this after the first estimate are not tried in a set.
LEAST_SHARE = 0.005
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # languages x BUCKETS


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str, letter: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of the lower-cased letters; one blank stands for
    what lies between words. Empty if there is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    is_letter = letter[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first non-letter after a word
    keep[0] = is_letter[1] if len(points) > 1 else False
    points = np.where(is_letter, points, np.uint32(32))[keep].astype(np.uint64)
    found = []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, np.uint64)
        for k in range(order):
            key = key * np.uint64(1_000_003) + points[k : k + n]
        if order == 1:
            key = key[points != 32]
        found.append(mix(key) >> np.uint64(64 - 16))
    return np.concatenate(found).astype(np.int64)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) < 4096:
        return np.unique(grams, return_counts=True)
    counts = np.bincount(grams, minlength=BUCKETS)
    where = np.flatnonzero(counts)
    return where, counts[where]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows of ``docs`` with a language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(
                batch.column("lang").to_pylist(), texts(batch, "text"), strict=True
            ):
                where, n = counted(ngrams(text, letter))
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[where] += n
        for lang, counts in sums.items():
            where = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(where), pa.string()),
                    pa.array(where, pa.int64()),
                    pa.array(counts[where]),
                ],
                ["lang", "bucket", "n"],
            )

    counts = rows.mapInArrow(tidy(run), "lang string, bucket long, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    total = np.full((len(languages), BUCKETS), SMOOTHING)
    at = {lang: i for i, lang in enumerate(languages)}
    total[counts["lang"].map(at).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"]
    return Model(languages, total / total.sum(axis=1, keepdims=True))


def proportions(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of the mixture shares: p is languages x n-grams."""
    share, total = start / start.sum(), n.sum()
    for _ in range(ROUNDS if len(share) > 1 else 0):
        new = share * (p @ (n / (share @ p))) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share / share.sum()


def mixture(model: Model, grams: np.ndarray) -> list[tuple[str, float]]:
    """The selected languages and their shares, largest first."""
    if not len(grams) or not model.languages:
        return []
    where, n = counted(grams)
    n = n.astype(float)
    p = np.ascontiguousarray(model.probability[:, where])
    start = np.full(len(p), 1 / len(p))
    share = proportions(p, n, start)
    order = [i for i in np.argsort(-share, kind="stable") if share[i] >= LEAST_SHARE]
    single = int(np.argmax(np.log(p) @ n))
    best, chosen = -np.inf, ([single], np.ones(1))
    for size in range(1, max(1, len(order)) + 1):
        members = [single] if size == 1 else order[:size]
        shares = proportions(p[members], n, share[members] + 1e-9)
        fit = n @ np.log(shares @ p[members]) / len(ORDERS)
        value = fit - 0.5 * (size - 1) * np.log(n.sum())
        if value > best:
            best, chosen = value, (members, shares)
        elif size > 2:
            break
    members, shares = chosen
    rows = [(model.languages[i], float(s)) for i, s in zip(members, shares, strict=True)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def language(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to ``lang_pred``, ``score`` and ``languages``
    (array of language and share)."""
    shared = spark.sparkContext.broadcast((model.languages, model.probability))
    of_share = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letter = letters()
        known = Model(*shared.value)
        for raw in batches:
            found = [mixture(known, ngrams(t, letter)) for t in decoded(raw)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0][0] if f else UNKNOWN for f in found], pa.string()),
                    pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                    pa.array([[{"lang": a, "share": s} for a, s in f] for f in found], of_share),
                ],
                ["lang_pred", "score", "languages"],
            )

    udf = F.arrow_udf(
        tidy(predict),
        "lang_pred string, score double, languages array<struct<lang:string,share:double>>",
        F.ArrowUDFType.SCALAR_ITER,
    )
    return lambda text: udf(text.cast("binary"))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``languages`` of every row."""
    found = language(docs.sparkSession, model)(F.col(text_col))
    return docs.select(F.col(id_col), found.alias("_language")).select(id_col, "_language.*")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(id_remainder(F.col(doc_id), 4) == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out()))
    return identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages"
    )
