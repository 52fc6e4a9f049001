"""Whitening of embeddings from an exact characteristic polynomial (operator 13).

Every entry c of a vector becomes the integer floor(256 c). The fit list is each distinct
integer vector once: n vectors with sums S. Its scatter M = n X'X - S S' = n^2 V (V: the
covariance) is an integer matrix, computed exactly:

1. tasks add up products of their vectors, in doubles where these are exact, else in longer
   integers; Spark adds up the partial sums as decimals;
2. the characteristic polynomial of M modulo each of enough 31-bit primes: Hessenberg form
   by elimination, then its recurrence. Primes are rows of a Spark job. Chinese remaindering
   gives the integer coefficients, whose size Maclaurin's inequality bounds (M has no
   negative eigenvalue, so |c_k| <= C(d, k) (trace / d)^k);
3. all roots are real, so by Descartes' rule the sign changes of p(x + a) are exactly the
   number of roots above a. Bisection on that count isolates the largest roots, their
   multiplicity included, and on the sign of p refines a simple one, both in integers, to
   ``ROOT_BITS`` significant bits;
4. components by inverse iteration on M - root, which is singular up to the root's last
   bit: elimination in ``DIGITS`` decimal digits, orthogonal to the earlier components of an
   equal root. The largest entry of a component is positive.

Size: the driver holds d x d integers, where d is the length of a vector, and the residues
of d + 1 coefficients a prime. Neither grows with the rows. Steps 3 and 4 cost some d^3 long
operations there. Rows are read in Arrow batches.

Defined cases: vectors that are null or hold a null or non-finite entry give no rows; so do
components of eigenvalue 0 (a single vector, or all equal, gives no rows at all); floor is
cut to the range of a long; shorter vectors end in zeros; rows that repeat an id are rows of
their own, and equal vectors fit once; null ids are kept; a deviation beyond a long is null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import list_column, received, sent, table, tidy
from dealgrid.plans.sizing import materialize

SCALE = 256
COMPONENTS = 4
PRIME_BELOW = 1 << 31
ROOT_BITS, DIGITS = 100, 60
#: Sums travel as two decimals, value = high * LIMB + low.
LIMB = 1 << 62
LONG = (1 << 63) - 1


# --- integer vectors and their sums ------------------------------------------------------


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, x`` of the rows that take part; ``x`` all of the longest length."""
    some = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c)
    )
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    taken = rows.filter(some).select(F.col(id_col), x.alias("x"))
    longest = taken.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))
    return taken.withColumn("x", F.concat("x", zeros))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat, at = list_column(batch, "x")
    return flat[at[0] : at[-1]].reshape(batch.num_rows, -1)


def exact_products(x: np.ndarray) -> np.ndarray:
    """X'X as Python integers."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    bound = len(x) * most * most
    if bound < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    if bound < LONG:
        return (x.T @ x).astype(object)
    y = x.astype(object)
    return y.T @ y


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, S and n X'X - S S' of the vectors ``x`` of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch)
                n += len(x)
                sums = sums + x.astype(object).sum(axis=0)
                products = products + exact_products(x)
        if not n:
            return
        d = len(sums)
        above = [(i, j) for i in range(d) for j in range(i, d)]
        entries = [(-1, -1, n), *[(-1, i, s) for i, s in enumerate(sums)]]
        entries += [(i, j, products[i, j]) for i, j in above]
        limbs = [divmod(int(v), LIMB) for _, _, v in entries]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([e[0] for e in entries], pa.int32()),
                pa.array([e[1] for e in entries], pa.int32()),
                pa.array([Decimal(h) for h, _ in limbs], pa.decimal128(38, 0)),
                pa.array([Decimal(low) for _, low in limbs], pa.decimal128(38, 0)),
            ],
            ["i", "j", "high", "low"],
        )

    sums = fit.select("x").mapInArrow(tidy(run), "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = {
        (r["i"], r["j"]): int(r["high"]) * LIMB + int(r["low"])
        for r in sums.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    }
    n = found.get((-1, -1), 0)
    d = sum(i == -1 for i, _ in found) - 1
    s = [found[-1, i] for i in range(max(d, 0))]
    m = np.empty((len(s), len(s)), object)
    for i, j in itertools.combinations_with_replacement(range(len(s)), 2):
        m[i, j] = m[j, i] = n * found[i, j] - s[i] * s[j]
    return n, s, m


# --- the characteristic polynomial -------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin; the bases 2, 3, 5 and 7 decide all n below 3.2e9."""
    if n < 11 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    twos = ((n - 1) & -(n - 1)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> twos, n)
        if x not in (1, n - 1) and all(pow(x, 1 << k, n) != n - 1 for k in range(1, twos)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below ``PRIME_BELOW`` whose product exceeds ``bound``."""
    out, product = [], 1
    candidates = (p for p in range(PRIME_BELOW - 1, 2, -2) if _is_prime(p))
    while product <= bound:
        out.append(next(candidates))
        product *= out[-1]
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p < 2^31, from the constant up."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :, k:] = (h[k + 2 :, k:] - factor[:, None] * h[k + 1, k:]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    # minors[k]: the polynomial of the leading k x k block
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        own = np.roll(minors[k - 1], 1) - h[k - 1, k - 1] * minors[k - 1] % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            own = own - below * int(h[i - 1, k - 1]) % p * minors[i - 1] % p
        minors[k] = own % p
    return minors[d]


def chinese_remainder(residues: dict[int, np.ndarray]) -> list[int]:
    """The integers of least size with these residues, by prime."""
    total, modulus = np.zeros(len(next(iter(residues.values()))), object), 1
    for p, residue in residues.items():
        inverse = pow(modulus, -1, p)
        total = total + modulus * ((residue.astype(object) - total) * inverse % p)
        modulus *= p
    return [int(c - modulus if 2 * c > modulus else c) for c in total]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, from the constant up; a task works on some primes."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("prime").to_pylist()
            found = [polynomial_mod(shared.value, p).tobytes() for p in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("prime"), pa.array(found, pa.binary())], ["prime", "residues"]
            )

    parts = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(parts, "prime")
    found = rows.mapInArrow(tidy(run), "prime long, residues binary").collect()
    return chinese_remainder({r["prime"]: np.frombuffer(r["residues"], np.int64) for r in found})


# --- its largest roots -------------------------------------------------------------------


def roots_above(coefficients: list[int], m: int, s: int) -> int:
    """How many roots exceed m / 2^s, for a polynomial whose roots are real: the sign changes
    of p(a (x + 1)), which has the roots root / a - 1."""
    d = len(coefficients) - 1
    high_first = [c * m**k << s * (d - k) for k, c in enumerate(coefficients)][::-1]
    shifted = []
    for _ in range(d + 1):  # synthetic division by x - 1, again and again
        high_first = list(itertools.accumulate(high_first))
        shifted.append(high_first.pop())
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in itertools.pairwise(signs))


def sign_at(coefficients: list[int], m: int, s: int) -> int:
    value = 0
    for back, c in enumerate(reversed(coefficients)):
        value = value * m + (c << s * back)
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root between ``m`` and ``m + 1`` over 2^``s``, and how often it occurs there."""

    m: int
    s: int
    times: int

    def value(self) -> Decimal:
        return (Decimal(self.m) + Decimal("0.5")) / Decimal(1 << self.s)


def largest_roots(coefficients: list[int], wanted: int) -> list[Root]:
    """The largest positive roots, ``wanted`` of them with multiplicity, or all."""
    zeros = next((k for k, c in enumerate(coefficients) if c), len(coefficients) - 1)
    p = coefficients[zeros:]
    degree = len(p) - 1
    out: list[Root] = []
    done = 0
    top = abs(p[-2]) + 1 if degree else 1  # the trace bounds every root
    while done < min(wanted, degree):
        # the root number ``done`` + 1 lies in (low, high] / 2^s
        low, high, s = 0, top, 0
        above_low, above_high = degree, 0
        while low.bit_length() < ROOT_BITS or high - low > 1:
            if high - low == 1:
                low, high, s = low << 16, high << 16, s + 16
            middle = (low + high) // 2
            if above_low - above_high == 1:
                # p is positive beyond all roots and changes sign at each
                sign = sign_at(p, middle, s)
                right = sign == 0 or (sign > 0) == (above_high % 2 == 0)
                above = above_high if right else above_low
            else:
                above = roots_above(p, middle, s)
            if above > done:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        out.append(Root(low, s, above_low - done))
        done = above_low
    return out


# --- components --------------------------------------------------------------------------


def null_space(matrix: np.ndarray, root: Decimal, times: int) -> list[np.ndarray]:
    """``times`` orthonormal vectors of which the matrix makes ``root`` times themselves."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        least = root.scaleb(-DIGITS + 10)
        order = np.arange(d)
        for k in range(d):  # elimination in place, factors below the diagonal
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            if pivot != k:
                a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(b: np.ndarray) -> np.ndarray:
            y = b[order].copy()
            for k in range(1, d):
                y[k] -= a[k, :k] @ y[:k]
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - a[k, k + 1 :] @ y[k + 1 :]) / a[k, k] if k + 1 < d else y[k] / a[k, k]
            return y

        out: list[np.ndarray] = []
        for number in range(times):
            # starts that differ in a fixed, irregular way
            v = np.array([Decimal(1 + (i * 7919 + number * 104729 + 13) % 1009) for i in range(d)], object)
            for _ in range(4):
                v = solve(v)
                for _ in range(2):
                    for u in out:
                        v = v - (u @ v) * u
                    v = v / (v @ v).sqrt()
            out.append(v)
        return [v if v[np.argmax(np.abs(v))] > 0 else -v for v in out]


@dataclass(frozen=True)
class Whitening:
    """``weights``: one column a component, its unit vector over the root of its eigenvalue.
    ``explained``: the eigenvalues' shares of the trace."""

    n: int
    sums: tuple[int, ...]
    weights: np.ndarray
    explained: tuple[float, ...]


def learn(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of ``vectors`` (``x``), None without a positive eigenvalue; and the fit
    list."""
    fit = materialize(vectors.select("x").distinct(), "fit_list")
    n, sums, matrix = scatter(fit)
    trace = int(sum(matrix[i, i] for i in range(len(sums))))
    if not trace:
        return None, fit
    weights, explained = [], []
    polynomial = characteristic_polynomial(vectors.sparkSession, matrix)
    for root in largest_roots(polynomial, components):
        with localcontext() as context:
            context.prec = DIGITS
            value = root.value()
            spread = value.sqrt() / n
            own = null_space(matrix, value, root.times)
            weights += [[float(c / spread) for c in v] for v in own]
            explained += [float(value / trace)] * len(own)
    w = np.array(weights[:components]).T
    return Whitening(n, tuple(sums), w, tuple(explained[:components])), fit


def _deviations(x: np.ndarray, found: Whitening) -> np.ndarray:
    """n x - S, exact."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if found.n * most + max(map(abs, found.sums)) < LONG:
        return found.n * x - np.array(found.sums, np.int64)
    return found.n * x.astype(object) - np.array(found.sums, object)


def _whitened(deviations: np.ndarray, found: Whitening) -> np.ndarray:
    return (deviations.astype(np.float64) / found.n) @ found.weights


def _square_sums(deviations: np.ndarray) -> list[int | None]:
    most = int(np.abs(deviations).max(initial=0))
    if most * most * max(1, deviations.shape[1]) < LONG:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = (deviations.astype(object) ** 2).sum(axis=1)
    return [int(v) if v <= LONG else None for v in exact]


def identity_error(fit: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(found.explained)
    pairs = list(itertools.combinations_with_replacement(range(k), 2))
    names = [f"m{i}" for i in range(k)] + [f"c{i}_{j}" for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = _whitened(_deviations(_vectors(batch), found), found)
                sums += z.sum(axis=0)
                products += z.T @ z
        figures = [*sums, *[products[i, j] for i, j in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in figures], names)

    rows = fit.mapInArrow(tidy(run), ", ".join(f"{c} double" for c in names))
    total = rows.agg(*[F.sum(c).alias(c) for c in names]).first()
    mean = [total[f"m{i}"] / found.n for i in range(k)]
    return max(abs(total[f"c{i}_{j}"] / found.n - mean[i] * mean[j] - (i == j)) for i, j in pairs)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row a vector and component (see the module notes)."""
    vectors = integer_vectors(rows, id_col, vector_col)
    found, fit = learn(vectors, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SCHEMA}"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, found)
    shared = sent(rows.sparkSession, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shared)
        k = len(model.explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            deviations = _deviations(_vectors(batch), model)
            z = _whitened(deviations, model)
            each = np.repeat(np.arange(batch.num_rows), k)
            m = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(m, model.n)),
                    pa.array(_square_sums(deviations), pa.int64()).take(pa.array(each)),
                    pa.array(z.reshape(-1)),
                    pa.array(np.tile(np.array(model.explained), batch.num_rows)),
                    pa.array(np.full(m, error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(id_col, "x").mapInArrow(tidy(run), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
