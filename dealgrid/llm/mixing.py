"""Mixing sources to target weights by soft membership (operator 6).

1. A softmax classifier of hashed words, fitted with numpy on at most
   ``SAMPLE_ROWS`` labelled documents (those of smallest id hash), gives each
   document a posterior over the domains of the labelled table: ``high`` and
   ``low`` quality, and ``toxic``.
2. Domain d should hold ``weights[d]`` of the tokens. With n_i tokens and
   posterior p_i, nonnegative rates r_i minimise

       1/2 sum_d (sum_i n_i r_i p_id - t_d)^2 / s_d + keep/2 sum_i n_i (r_i - 1)^2,

   s_d = sum_i n_i p_id, by projected gradient steps. Each residual counts by its
   domain's own supply s_d, so a rare domain is fitted as closely as a frequent one.
   The objective bends in D directions, and by ``keep`` in all others, so that steps of
   one length would need about 1 / keep of them: a step is scaled by the inverse of the
   curvature on the rates that are not 0, which needs a D x D matrix only, and
   projected to nonnegative rates. Such a step stays among the rates
   max(0, 1 - p_i * prices / keep) of D numbers, the prices; it is halved until a lower
   bound of the objective (its dual at the prices) rises enough. The gap between objective
   and bound proves how near the rates are to the fitted ones; the descent ends at
   ``RATE_ERROR``. Each step is one Spark job that returns D + 1 + D * D sums per task; a
   document's rate follows from its own row and the prices, so no state is kept and a lost
   task is simply run again.
3. A document is taken floor(rate + u) times, u the hash of its id.

Only (id, tokens, posteriors) is written to the shared checkpoint folder; the
texts are read once. Nothing is shuffled by source or domain.

Defined cases: null and blank texts have no tokens, posterior of the classifier's
intercepts, and take part with weight 0; without labels the posterior is
uniform; repeated rows have equal rates; null ids hash like any value; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import list_column, table, tidy, whole_text
from dealgrid.plans.sizing import materialize

DOMAINS = ("high", "low", "toxic")
#: Target share of the tokens.
WEIGHTS = {"high": 0.97, "low": 0.03, "toxic": 0.0}
#: Unless a budget is given, the heaviest domain is used so many times.
USES = 1.05
SAMPLE_ROWS = 8_000
FEATURES = 1 << 17
EPOCHS, STEP = 6, 0.5
#: Weight of rates that stay at 1, against a domain's residual: about the rate to which a
#: domain of target 0 is brought, however rare. A smaller one drives out clean documents
#: with a trace of such a domain in their posterior.
KEEP = 1e-3
#: The descent ends when the rates are proven to be so near the fitted ones (root of the
#: mean square over tokens).
RATE_ERROR = 1e-3
#: More jobs raise an error.
JOBS = 200

#: Between words: blanks and ASCII punctuation.
BETWEEN = r"[\x09-\x0D -/:-@\[-`{-~]+"
#: Bytes whose shares of a text are features besides its words.
SYMBOLS = np.frombuffer(b"#*$%&|<>!", np.uint8)
CAPITALS = np.arange(ord("A"), ord("Z") + 1)
#: Spark's hash of the empty text, which ``split`` leaves at the ends of a text.
NO_WORD = np.int64(xxhash.xxh64_intdigest(b"", seed=42) - (1 << 64))


@dataclass
class Classifier:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(DOMAINS)), np.float32))
    marks: np.ndarray = field(default_factory=lambda: np.zeros((3, len(DOMAINS)), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS), np.float32))

    def posterior(self, words: np.ndarray, marks: np.ndarray) -> np.ndarray:
        score = self.bias + marks @ self.marks
        if len(words):
            score = score + self.weights[words].sum(axis=0) / np.sqrt(len(words))
        odds = np.exp(score - score.max())
        return odds / odds.sum()


def features(df: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """The ``kept`` columns, the text's bytes and its hashed words."""
    words = F.split(F.lower(whole_text(F.col(text_col))), BETWEEN)
    return df.select(
        *kept,
        F.col(text_col).cast("binary").alias("_text"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"),
    )


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text: number of words, buckets of its distinct words, and the roots
    of its shares of symbols, of capitals, and of words equal to the one before."""
    flat, at = list_column(batch, "_words")
    for i, raw in enumerate(batch.column("_text").to_pylist()):
        words = flat[at[i] : at[i + 1]]
        words = words[words != NO_WORD]
        seen = np.bincount(np.frombuffer(raw or b"", np.uint8), minlength=256)
        twice = np.count_nonzero(words[1:] == words[:-1]) / max(1, len(words))
        size = max(1, seen.sum())
        share = np.array([seen[SYMBOLS].sum() / size, seen[CAPITALS].sum() / size, twice])
        yield len(words), np.unique(words & (FEATURES - 1)), np.sqrt(share).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> Classifier:
    """Softmax regression by stochastic gradient descent with per-weight steps."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    sample = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .select(F.col("doc_id").alias(id_col), domain.alias("domain"))
        .dropDuplicates([id_col])
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(SAMPLE_ROWS)
    )
    found = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    found = features(found.withColumn("_id", F.col(id_col).cast("string")), ["_id", "domain"], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(vectors(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([w.astype(np.int32) for _, w, _ in found], pa.list_(pa.int32())),
                    pa.array([m for _, _, m in found], pa.list_(pa.float32())),
                ],
                ["id", "domain", "words", "marks"],
            )

    rows = found.mapInArrow(tidy(run), "id string, domain int, words array<int>, marks array<float>")
    rows = sorted(rows.toArrow().to_pylist(), key=lambda r: (r["id"], r["domain"], r["words"]))
    model = Classifier()
    order = np.random.Generator(np.random.PCG64(6))
    words = [np.array(r["words"], np.int64) for r in rows]
    marks = [np.array(r["marks"], np.float32) for r in rows]
    domains = [r["domain"] for r in rows]
    grown = np.full_like(model.weights, 1e-3)
    grown_marks, grown_bias = np.full_like(model.marks, 1e-3), np.full_like(model.bias, 1e-3)
    for _ in range(EPOCHS):
        for i in order.permutation(len(words)):
            slope = model.posterior(words[i], marks[i]).astype(np.float32)
            slope[domains[i]] -= 1
            if len(words[i]):
                g = slope / np.float32(np.sqrt(len(words[i])))
                grown[words[i]] += g * g
                model.weights[words[i]] -= STEP * g / np.sqrt(grown[words[i]])
            g = np.outer(marks[i], slope)
            grown_marks += g * g
            model.marks -= STEP * g / np.sqrt(grown_marks)
            grown_bias += slope * slope
            model.bias -= STEP * slope / np.sqrt(grown_bias)
    return model


def posteriors(
    docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_tokens, posterior`` (array in the order of ``DOMAINS``)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.marks, model.bias))
    rows = features(docs, [id_col], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(*shared.value)
        for batch in batches:
            found = list(vectors(batch))
            out = [known.posterior(w, m) for _, w, m in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([p.astype(float) for p in out], pa.list_(pa.float64())),
                ],
                [id_col, "n_tokens", "posterior"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, posterior array<double>")


def rates(posterior: np.ndarray, prices: np.ndarray, keep: float) -> np.ndarray:
    """The rates at the domains' ``prices``: where no rate is 0, the gradient of the second
    term equals that of the first with ``prices`` as its slopes."""
    return np.maximum(0.0, 1 - posterior @ prices / keep)


def moments(posterior: np.ndarray, n: np.ndarray, prices: np.ndarray, keep: float) -> np.ndarray:
    """Sums over documents: tokens of each domain, squares of the rates' distances from 1,
    and products of the domains over the tokens of documents whose rate is not 0."""
    rate = rates(posterior, prices, keep)
    free = posterior * np.where(rate > 0, n, 0)[:, None]
    return np.concatenate([(n * rate) @ posterior, [n @ (rate - 1) ** 2], (free.T @ posterior).ravel()])


def _moments(members: DataFrame, prices: np.ndarray, keep: float) -> np.ndarray:
    width = len(DOMAINS)
    names = [f"s{i}" for i in range(width + 1 + width * width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        for batch in batches:
            p = list_column(batch, "posterior")[0].reshape(-1, width)
            total += moments(p, batch.column("n_tokens").to_numpy(), prices, keep)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

    sums = members.select("n_tokens", "posterior").mapInArrow(tidy(run), ", ".join(f"{n} double" for n in names))
    return np.array([x or 0.0 for x in sums.agg(*[F.sum(n).alias(n) for n in names]).first()])


@dataclass
class Mix:
    prices: np.ndarray
    targets: np.ndarray
    totals: np.ndarray
    keep: float
    jobs: int


def descend(
    measure: Callable[[np.ndarray], np.ndarray], now: np.ndarray, targets: np.ndarray, keep: float
) -> Mix:
    """The fitted rates. ``measure`` gives the ``moments`` at some prices, ``now`` are those
    at prices of 0."""
    width = len(targets)
    supply = now[:width]
    per = np.divide(1.0, supply, out=np.zeros(width), where=supply > 0)
    near = RATE_ERROR**2 * keep * supply.sum()

    def bound(prices: np.ndarray, found: np.ndarray) -> float:
        """What the objective cannot fall below; equal to it at the fitted rates."""
        return prices @ (found[:width] - targets) + keep / 2 * found[width] - supply @ prices**2 / 2

    prices, jobs = np.zeros(width), 1
    while True:
        apart = (now[:width] - targets) * per - prices
        if supply @ apart**2 <= near:
            return Mix(prices, targets, now[:width], keep, jobs)
        bend = np.eye(width) + per[:, None] * now[width + 1 :].reshape(width, width) / keep
        step, part = np.linalg.solve(bend, apart), 1.0
        least, gain = bound(prices, now), (supply * apart) @ step
        while True:
            if jobs >= JOBS:
                raise RuntimeError(f"rates not fitted after {jobs} jobs: totals {now[:width]}, targets {targets}")
            after, jobs = measure(prices + part * step), jobs + 1
            if bound(prices + part * step, after) >= least + 1e-4 * part * gain:
                break
            part /= 2
        prices, now = prices + part * step, after


def solve(
    members: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, keep: float = KEEP
) -> Mix:
    """Fits the rates. ``budget`` is the wanted number of tokens; unset, as many
    as use the domain of the largest weight ``USES`` times."""
    share = np.array([(weights or WEIGHTS)[d] for d in DOMAINS], float)
    share = share / share.sum()
    start = _moments(members, np.zeros(len(DOMAINS)), keep)
    supply = start[: len(DOMAINS)]
    if budget is None:
        heaviest = int(np.argmax(share))
        budget = USES * float(supply[heaviest] / share[heaviest])
    return descend(lambda prices: _moments(members, prices, keep), start, share * budget, keep)


def apply(members: DataFrame, mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """``members`` with ``rate`` and ``copies``."""
    width = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = list_column(batch, "posterior")[0].reshape(-1, width)
            rate = rates(p, mix.prices, mix.keep)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rate, pa.float64())], [*batch.schema.names, "rate"]
            )

    kind = members.schema[id_col].dataType.simpleString()
    rows = members.select(id_col, "n_tokens", "posterior").mapInArrow(
        tidy(run), f"`{id_col}` {kind}, n_tokens long, posterior array<double>, rate double"
    )
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("copies", F.floor(F.col("rate") + u).cast("long"))


def mix_documents(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None
) -> DataFrame:
    """doc_id, n_tokens, posterior, rate and copies of every row."""
    members = materialize(posteriors(docs, fit(docs, labels)), "posteriors")
    return apply(members, solve(members, weights, budget))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix_documents(docs, table(spark, sf_dir, "labels"))
    return mixed.select(
        "doc_id",
        "n_tokens",
        *[F.get("posterior", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        "rate",
        "copies",
    )
