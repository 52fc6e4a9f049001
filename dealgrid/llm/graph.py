"""Joins against hot keys, and connected components.

Both work on tables in the shared checkpoint folder (``materialize``), so lost
executors cost at most the running step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.plans.sizing import materialize

SALTS = 16
#: Rows of a narrow table that are worth a file of their own.
FILE_ROWS = 100_000
LEAST_FILES = 12


def stored(df: DataFrame, name: str, most_rows: int) -> DataFrame:
    """``df`` written to the shared folder, in fewer files where it has few rows for
    its partitions: ``most_rows`` bounds its rows, so files grow with the data."""
    return materialize(df.coalesce(max(LEAST_FILES, math.ceil(most_rows / FILE_ROWS))), name)


def salted_join(
    big: DataFrame, one: DataFrame, key: str | list[str], spread: Column, how: str
) -> DataFrame:
    """``big`` joined with ``one`` (at most one row a key, and few keys
    against ``big``) on ``key``. A key's rows in ``big`` are dealt to
    ``SALTS`` partitions by ``spread``; ``one`` is repeated for each."""
    on = [key] if isinstance(key, str) else key
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    return left.join(one.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


def _checksum(edges: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(digest), F.sum(digest % 1_000_003)).first())


def components(edges: DataFrame, most_edges: int) -> DataFrame:
    """``node, component`` for every node of the undirected ``edges(u, v)``;
    ``component`` is the smallest node reachable.

    Alternating large-star and small-star steps: every node links its larger
    (then smaller) neighbours to the smallest one it knows, until nothing
    changes. Each step is an aggregation and a salted join of the edge list,
    so a hub with very many neighbours is spread over tasks."""
    current = stored(
        edges.filter("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct(),
        "edges",
        most_edges,
    )
    seen = _checksum(current)
    edges_now = seen[0]
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.filter("v > u"), low, "u", F.col("v"), "inner").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", F.col("v"), "inner")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        # a step never makes more edges than it had nodes and edges
        current = stored(small.filter("u <> v").distinct(), "small_star", 2 * edges_now)
        now = _checksum(current)
        if now == seen:
            break
        seen, edges_now = now, now[0]
    stars = current.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
