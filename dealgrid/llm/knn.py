"""Exact top-k inner products by KD-trees per shard (operator 3).

Vectors are dealt by id hash to shards of about ``SHARD_ROWS`` and queries to
blocks of about ``BLOCK_QUERIES``; a task holds one shard and one block,
whatever the table's size. In a shard, a KD-tree splits at the median of the
widest component, each node with its tight bounding box; the box bound of a
query q is sum_j max(q_j low_j, q_j high_j). A query's traversal is best-first:
the open node of the highest bound next, until no bound reaches the kth score.

A first pass runs each block on one shard; the kth scores found there go with
the queries to all other shards as their starting bound, so that most boxes are
never opened and a shard returns only what can still be among the best.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without id, take no part; vectors are compared with those of the same
length only; rows that share the query's id are its own; repeated rows are
candidates each; ties go to the smaller id; fewer than k candidates give fewer
rows; an empty table gives an empty result; other columns are not read. Scores
beyond 64 bits are not defined.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrid.llm.common import list_column, table
from dealgrid.plans.sizing import materialize

SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
LEAF_ROWS = 128


class Tree:
    """Median splits; ``rows`` is ordered so that each node is a slice."""

    def __init__(self, vectors: np.ndarray) -> None:
        n = len(vectors)
        self.rows = np.arange(n)
        self.children: list[tuple[int, int] | None] = []
        self.slices: list[tuple[int, int]] = []
        lows, highs = [], []
        todo = [(0, n, None)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.slices)
            part = vectors[self.rows[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            self.slices.append((a, b))
            self.children.append(None)
            lows.append(low)
            highs.append(high)
            if parent is not None:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if b - a > LEAF_ROWS and (high > low).any():
                middle = (b - a) // 2
                order = np.argpartition(part[:, int(np.argmax(high - low))], middle)
                self.rows[a:b] = self.rows[a:b][order]
                todo += [(a + middle, b, node), (a, a + middle, node)]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product: queries x nodes."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def best(
    tree: Tree, ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray,
    bounds: np.ndarray, k: int, floor: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a shard with at least ``floor``;
    ``ids`` and ``vectors`` are in the tree's order."""
    top_ids, top = np.empty(0, ids.dtype), np.empty(0, vectors.dtype)
    heap = [(-bounds[0], 0)]
    while heap:
        negative, node = heapq.heappop(heap)
        if -negative < floor:
            break
        if tree.children[node]:
            for child in tree.children[node]:
                if bounds[child] >= floor:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        a, b = tree.slices[node]
        scores = vectors[a:b] @ query
        good = np.flatnonzero((scores >= floor) & (ids[a:b] != own))
        if not len(good):
            continue
        top_ids = np.concatenate([top_ids, ids[a:b][good]])
        top = np.concatenate([top, scores[good]])
        if len(top) > k:
            order = np.lexsort((top_ids, -top))[:k]
            top_ids, top = top_ids[order], top[order]
        if len(top) == k:
            floor = max(floor, top.min())
    return top_ids, top


def _matrix(rows: pa.Table) -> np.ndarray:
    batch = rows.combine_chunks().to_batches()[0]
    values, at = list_column(batch, "vector")
    return values[at[0] : at[-1]].reshape(len(batch), -1)


def _pass(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best rows of each (shard, block) pair. Both sides carry dim, shard,
    block."""
    key = ["dim", "shard", "block"]

    def search(block: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if block.num_rows and shard.num_rows:
            q, v = _matrix(block), _matrix(shard)
            largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
            if largest * v.shape[1] < 2**53:  # sums are exact in doubles
                q, v = q.astype(float), v.astype(float)
            tree = Tree(v)
            ids = shard.column("vec_id").to_numpy()[tree.rows]
            v = v[tree.rows]
            bounds = tree.bounds(q)
            floors = block.column("floor").to_pylist()
            for i, own in enumerate(block.column("query_id").to_pylist()):
                floor = -math.inf if floors[i] is None else floors[i]
                got, score = best(tree, ids, v, own, q[i], bounds[i], k, floor)
                found.append((np.full(len(got), own), got, score.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return queries.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(
        search, "query_id long, vec_id long, score long"
    )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``. Both inputs: vec_id, vector
    (array<long>)."""
    vectors = materialize(vectors.withColumn("dim", F.size("vector")), "vectors")
    queries = materialize(
        queries.withColumn("dim", F.size("vector")).dropDuplicates(["vec_id", "vector"]), "queries"
    )
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_queries))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.select(
        "dim", F.col("vec_id").alias("query_id"), "vector", deal(blocks).alias("block")
    )
    v = vectors.withColumn("shard", deal(shards)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    pilot = F.pmod("block", F.lit(shards)).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _pass(
        q.withColumns({"shard": pilot, "floor": F.lit(None).cast("double")}),
        v.filter(F.col("shard") == pilot), k,
    )
    first = materialize(first, "first_pass")
    if shards > 1:
        floors = first.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor")
        )
        others = q.join(floors, "query_id", "left").withColumn(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        )
        rest = _pass(others.filter(F.col("shard") != pilot), v.filter(F.col("shard") != pilot), k)
        first = first.unionByName(rest)
    ranked = first.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and floor(scale * x) of each component; unfit vectors left out."""
    x = F.col(vector_col).cast("array<double>")
    fit: Column = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    )
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fit)
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("vector"),
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"), 1024, "vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.w) = len(q.w)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
