"""Joins whose large side may hold a hot key (or many NULL keys).

A key may hold a third of all rows of the large side; in a plain shuffle join
all of them land in one task. Two forms:

* ``spread_join(big, small, on, spread)``: ``small`` is written and measured;
  under the broadcast limit (``dictionary_limit``) it is broadcast, rows with their payload counted.
  Otherwise the join is salted: rows of ``big`` are dealt to several tasks per
  key by a hash of ``spread`` and ``small`` is repeated for each; ``SALTS`` times, or fewer
  where the copies would outgrow ``big``. For dictionaries against a larger table.
  The planner sizes ``small`` by its compressed files and not by its copies, so a salted join
  carries a sort-merge hint: what was measured as too large is not broadcast after all.
* ``meet(left, right, ...)``: for two written tables either of which may be the larger
  one. Both are measured, and the smaller takes the place of ``small`` above.
* ``split_hot_join(big, other, ...)``: for two large tables, where repeating
  ``other`` would cost too much. The ``MAX_HOT_KEYS`` most
  frequent keys of ``big`` above ``dealgrid.hotKeyRows`` rows are hot. Their rows
  join as in ``spread_join``; the rest is shuffle-joined, and no key of it holds
  more than the threshold or 1 / ``MAX_HOT_KEYS`` of the rows.

Rows of ``big`` whose key is NULL never match; left and anti joins keep them
beside the join, so they are not shuffled to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.plans.sizing import broadcast_limit, byte_count, materialize, relation_bytes

HOT_KEY_CONF = "dealgrid.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 1_000_000
MAX_HOT_KEYS = 1_000
SALTS = 16
# The driver holds a relation several times over while it is collected, hashed and sent,
# and may send several at a time.
MAX_DICTIONARY_BYTES = 16 * 1024 * 1024


def hot_key_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_KEY_CONF, str(DEFAULT_HOT_KEY_ROWS)))


def dictionary_limit(spark: SparkSession) -> int:
    return min(broadcast_limit(spark), MAX_DICTIONARY_BYTES)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (what the planner itself uses to
    choose a broadcast join)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001


def planner_broadcasts(df: DataFrame) -> bool:
    """Whether the planner would broadcast ``df`` on its own."""
    limit = byte_count(str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")))
    return 0 <= estimated_bytes(df) <= limit


def salts_for(big_bytes: int, small_bytes: int) -> int:
    """Copies of the small side: ``SALTS``, but together no more than the big side. A join of
    equals has no copies; a hot key is left to Spark's splitting of skewed partitions."""
    return max(1, min(SALTS, big_bytes // max(small_bytes, 1)))


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner", n: int = SALTS
) -> DataFrame:
    """``small`` repeated ``n`` times for rows of ``big`` dealt by ``spread``; never broadcast."""
    if n == 1:
        return big.join(small.hint("merge"), on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(n)]))
    return left.join(small.withColumn("_salt", salts).hint("merge"), [*on, "_salt"], how).drop("_salt")


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    name: str = "dictionary",
    written: bool = False,
) -> DataFrame:
    """``big`` joined to the dictionary ``small`` on equal columns ``on``. ``written``: ``small``
    is cheap to read again (a filter or projection of written tables), so it is only measured."""
    nulls = None
    if how in ("left", "left_anti"):
        some_null = F.lit(False)
        for c in on:
            some_null = some_null | F.col(c).isNull()
        nulls, big = big.filter(some_null), big.filter(~some_null)
    small = small if written else materialize(small, name)
    if relation_bytes(small) <= dictionary_limit(big.sparkSession):
        out = big.join(F.broadcast(small), on, how)
    else:
        big_bytes, small_bytes = estimated_bytes(big), estimated_bytes(small)
        if how == "inner" and big_bytes < small_bytes:
            out = big.join(small, on, how)  # the planner may send ``big``
        else:
            out = salted_join(big, small, on, spread, how, salts_for(big_bytes, small_bytes))
    return out if nulls is None else out.unionByName(nulls, allowMissingColumns=True)


def meet(
    left: DataFrame, right: DataFrame, on: list[str], left_spread: list[str], right_spread: list[str]
) -> DataFrame:
    """Inner join of two written tables on equal columns ``on``; the smaller is broadcast or
    repeated, the rows of the larger are dealt by a hash of its spread columns."""
    sides = [(relation_bytes(left), left, left_spread), (relation_bytes(right), right, right_spread)]
    (small_bytes, small, _), (big_bytes, big, spread) = sorted(sides, key=lambda side: side[0])
    if small_bytes <= dictionary_limit(left.sparkSession):
        return big.join(F.broadcast(small), on)
    return salted_join(big, small, on, spread, n=salts_for(big_bytes, small_bytes))


def split_hot_join(
    big: DataFrame,
    other: DataFrame,
    big_key: str,
    other_key: str,
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """``big`` joined to ``other`` on ``big[big_key] == other[other_key]`` (how:
    inner, left or left_anti), hot keys of ``big`` isolated."""
    keyed = other.withColumnRenamed(other_key, big_key)
    nulls = big.filter(F.col(big_key).isNull()) if how != "inner" else None
    big = big.filter(F.col(big_key).isNotNull())
    # counting reads only the key column of ``big``
    counts = big.groupBy(big_key).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts.filter(F.col("_n") > hot_key_rows(big)), "key_counts")
    if counts.isEmpty():
        # no key above the threshold: the plain join has no hot partition
        out = big.join(keyed, big_key, how)
    else:
        # at most MAX_HOT_KEYS rows: the largest counts
        hot = F.broadcast(
            materialize(counts.orderBy(F.desc("_n"), big_key).limit(MAX_HOT_KEYS).select(big_key), "hot_keys")
        )
        # read twice below (hot part, cold part): compute it once
        big = materialize(big, "split_input")
        hot_part = spread_join(
            big.join(hot, big_key, "left_semi"),
            keyed.join(hot, big_key, "left_semi"),
            [big_key], spread, how, "hot_rows",
        )
        cold_part = big.join(hot, big_key, "left_anti").join(keyed, big_key, how)
        out = hot_part.unionByName(cold_part)
    return out if nulls is None else out.unionByName(nulls, allowMissingColumns=True)
