"""Quality rules and robust multivariate outliers (operator 10).

Base rules count words, symbols, repeated lines and repeated five-word windows of
each text; a text with few words or many repeated ones fails. The method adds a
minimum-covariance-determinant (MCD) estimate per language and source: of the
vector of transformed statistics

    root of the symbols per character of words, root of the share of repeated lines,
    mean word length,

the half (``SUBSET``) of the group's rows with the smallest covariance determinant is
approached by concentration steps: distances by the current centre and covariance,
then centre and covariance of the rows of smallest distance, the covariance times
``CONSISTENT``, which the nearest half of normal rows needs to have the spread of all.
Up to half of a group may be outliers. The first centre and scale are column-wise medians and spreads, so the result does not depend on chance.
Rows whose squared Mahalanobis distance exceeds ``LIMIT`` are rejected.

All of it is DataFrame functions. Statistics are computed inside a row (the five-word
windows as hashes, and the costly count of covered words only where a hash repeats) and
written once; a concentration step is two aggregations of that narrow table with
map-side partial results. The distance below which ``SUBSET`` of a group lie is read off
counts in bins of 1/16 of a power of two, so no group is sorted or collected, and rows
with equal distances are taken together. Groups' estimates are few numbers; they are
joined salted, as one source may hold a third of the rows.

``FLOOR`` is added to the variances: a statistic that hardly varies in a group (no
symbols at all, say) must not turn small deviations into outliers.

Defined cases: null text has no words and fails; null language or source is a group of
its own; a group of one row keeps it if the base rules do; repeated rows count each;
null ids are kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import BLANKS, split_words, table, whole_text
from dealgrid.llm.graph import SALTS
from dealgrid.plans.sizing import materialize

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = "#*$%&|<>"
SUBSET, STEPS = 0.5, 8
#: SUBSET / P(X <= q) of chi-squared X with 5 degrees of freedom, q the quantile of
#: SUBSET with 3 degrees.
CONSISTENT = 2.458
#: Standard deviations added to each statistic's own, squared, and the largest
#: squared distance of three statistics that is kept: the chi-squared quantile of
#: 1 - 1e-5. Each statistic can exceed it alone; in a group without repeated lines a
#: text goes if more than 0.37 (LIMIT * 0.12^2) of its lines repeat.
FLOOR = (0.03, 0.12, 0.6)
LIMIT = 25.9
BINS = 16
VECTOR = ("x0", "x1", "x2")
GROUP = ("lang", "source")


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def statistics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words of every row."""
    text = whole_text(F.col(text_col))
    worded = F.filter(
        F.split(text, "\n", -1), lambda line: F.length(F.trim(line, F.lit(BLANKS))) > 0
    )
    rows = docs.select(
        F.col(id_col),
        *GROUP,
        F.length(_removed(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_removed(text, SYMBOLS))).cast("long").alias("n_symbols"),
        worded.alias("lines"),
        F.transform(split_words(text), lambda w: F.xxhash64(w)).alias("h"),
    )
    rows = rows.withColumn("n_windows", F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))
    window = F.transform(
        F.slice("h", F.lit(1), F.col("n_windows")),
        lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]),
    )
    rows = rows.withColumn("windows", window)
    rows = rows.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # positions of windows by hash, then by place; those next to an equal hash
    placed = F.when(
        F.col("repeats"),
        F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("w"), i.alias("i")))),
    )
    rows = rows.withColumn("placed", placed)

    def twice(x: Column, k: Column) -> Column:
        near = lambda j: F.coalesce(F.get("placed", j)["w"] == x["w"], F.lit(False))
        return F.when(near(k - 1) | near(k + 1), x["i"]).otherwise(F.lit(-1))

    found = F.sort_array(F.filter(F.transform("placed", twice), lambda i: i >= 0))
    rows = rows.withColumn("starts", found)
    # each start covers up to WINDOW words, or as many as lie before the next start
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return rows.select(
        id_col,
        *GROUP,
        F.size("h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _vector(stats: DataFrame) -> DataFrame:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return stats.withColumns(
        {
            "x0": F.sqrt(part("n_symbols", "word_chars")),
            "x1": F.sqrt(part("n_dup_lines", "n_lines")),
            "x2": part("word_chars", "n_words"),
        }
    )


def _with_estimates(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with their group's estimates; the many rows of one group are dealt
    to ``SALTS`` partitions."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*VECTOR, "doc"), F.lit(SALTS)).cast("int"))
    copies = estimates.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, ["lang", "source", "_salt"]).drop("_salt")


def _distance() -> Column:
    """Squared Mahalanobis distance by centre m0..m2 and covariance c00..c22."""
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(VECTOR)]
    c = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}

    def cofactor(i: int, j: int) -> Column:
        r, s = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        minor = c[r[0], s[0]] * c[r[1], s[1]] - c[r[0], s[1]] * c[r[1], s[0]]
        return minor if (i + j) % 2 == 0 else -minor

    total = reduce(
        lambda a, b: a + b, [cofactor(i, j) * d[i] * d[j] for i in range(3) for j in range(3)]
    )
    det = reduce(lambda a, b: a + b, [c[0, j] * cofactor(0, j) for j in range(3)])
    return total / det


def _bin(value: Column) -> Column:
    """Logarithmic bin of a value >= 0."""
    return F.floor(F.log2(value + F.lit(1e-9)) * BINS).cast("int")


def _moments() -> list[Column]:
    out = [F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR)]
    for i in range(3):
        for j in range(i, 3):
            floor = FLOOR[i] ** 2 if i == j else 0.0
            cov = F.covar_pop(F.col(VECTOR[i]), F.col(VECTOR[j])) * CONSISTENT + F.lit(floor)
            out.append(cov.alias(f"c{i}{j}"))
    return out


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """lang, source, edge: the least bin up to which ``share`` of a group lie."""
    counts = rows.groupBy(*GROUP, "bin").agg(F.count("*").alias("n"))
    counts = counts.groupBy(*GROUP).agg(
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total")
    )  # at most a few hundred bins a group
    edge = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("edge")),
        lambda acc, b: F.struct(
            (acc["seen"] + b["n"]).alias("seen"),
            F.coalesce(
                acc["edge"], F.when(acc["seen"] + b["n"] >= F.col("total") * share, b["bin"])
            ).alias("edge"),
        ),
        lambda acc: acc["edge"],
    )
    return counts.select(*GROUP, edge.alias("edge"))


def estimates(rows: DataFrame) -> DataFrame:
    """lang, source, centre and covariance. ``rows``: lang, source (not null), doc,
    x0..x2."""
    start = rows.groupBy(*GROUP).agg(
        *[F.percentile_approx(x, F.lit(0.5), F.lit(1000)).alias(f"m{i}") for i, x in enumerate(VECTOR)],
        *[
            F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), F.lit(1000)).alias(f"q{i}")
            for i, x in enumerate(VECTOR)
        ],
    )
    spread = lambda i: (F.get(f"q{i}", 1) - F.get(f"q{i}", 0)) / 1.349
    scale = {f"c{i}{i}": F.pow(spread(i), 2) + F.lit(FLOOR[i] ** 2) for i in range(3)}
    none = {f"c{i}{j}": F.lit(0.0) for i in range(3) for j in range(i + 1, 3)}
    current = materialize(
        start.withColumns(scale | none).drop("q0", "q1", "q2"), "estimates"
    )
    for _ in range(STEPS):
        binned = _with_estimates(rows, current).withColumn("bin", _bin(_distance()))
        edges = materialize(_nearest(binned, SUBSET), "edges")
        near = _with_estimates(
            rows, current.join(edges, list(GROUP))
        ).filter(_bin(_distance()) <= F.col("edge"))
        current = materialize(near.groupBy(*GROUP).agg(*_moments()), "estimates")
    return current


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every row, ``base_failed``, ``distance`` and ``kept``."""
    stats = statistics(docs, id_col, text_col).withColumns(
        {g: F.concat(F.lit("="), F.col(g)) for g in GROUP}
    )
    stats = stats.withColumns({g: F.coalesce(g, F.lit("")) for g in GROUP})
    rows = materialize(
        _vector(stats).withColumn("doc", F.xxhash64(id_col)).withColumn("base_failed", base_failed()),
        "statistics",
    )
    fitted = estimates(rows.select(*GROUP, "doc", *VECTOR))
    out = _with_estimates(rows, fitted).withColumn("distance", _distance())
    return out.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        (~F.col("base_failed") & (F.col("distance") <= LIMIT)).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", *GROUP))
