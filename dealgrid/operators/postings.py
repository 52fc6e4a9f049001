"""Early-ending top-k over blocked posting lists.

A *list* holds rows in the order in which they are to be preferred, and each *key* wants
the first ``k`` rows of its list that pass its own filters. Rows x keys would grow with the
product of both; a key here reads its list from the top, block by block, and stops:

1. ``build``: rows are sorted by list and preference with a range partitioning, so a
   list of any length spreads over tasks. ``BLOCK_ROWS`` rows in a row of a partition are
   a block. A block's number, taken from its partition and place, rises along the list;
   its rank in the list is a count of the list's blocks in earlier partitions plus its
   place in its own, so no window runs over a whole list.
2. A *summary* a block (nearest distance, best rating, lowest and highest price) tells
   which keys some row of the block may satisfy.
3. ``first_k``: rounds. In each, the keys that still lack rows meet the summaries of their
   list's next ranks (``FIRST_BLOCKS`` of them, ``GROWTH`` times as many in every further
   round); blocks that may hold a match are read, rows filtered exactly, and the best k of a
   key kept. Since blocks come in list order, a key with k rows is finished. The others go
   on, until the lists end.

A key whose filters pass often reads O(k) rows, however long its list is; one whose
filters pass seldom reads the blocks that the summaries cannot rule out.

Sorting a list into blocks shuffles and writes all its rows. So ``top_k`` first reads a *head*
of each list, about ``HEAD_ROWS`` rows, up to a bound that is a row of the list itself: the rows
not after it are a prefix, wherever it lies (a sample places it; results do not depend on it).
Only rows behind the bounds of lists whose keys still lack rows, and may find some there, are
sorted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrid.plans.sizing import materialize, relation_bytes
from dealgrid.plans.skew import dictionary_limit, meet, spread_join

DIRECT_CONF = "dealgrid.topk.directRows"
DEFAULT_DIRECT_ROWS = 1_000_000
BLOCK_ROWS = 256
FIRST_BLOCKS, GROWTH = 4, 8
#: Rows of a list that are read before any are sorted, about; one row in ``BOUND_SAMPLE`` is looked at
#: to place their end.
HEAD_ROWS, BOUND_SAMPLE = 1024, 16
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


@dataclass
class Blocks:
    """``rows``: the rows with ``list_id`` and ``block``. ``summaries``: ``list_id, block, rank``
    and the summary columns."""

    rows: DataFrame
    summaries: DataFrame


def build(rows: DataFrame, order: list[Column], summary: list[Column], name: str = "postings") -> Blocks:
    """Blocks of ``rows`` (``list_id`` and others); ``order``: preference within a list;
    ``summary``: aggregates of a block, aliased."""
    block_bits = BLOCK_ROWS.bit_length() - 1
    ordered = rows.repartitionByRange("list_id", *order).sortWithinPartitions("list_id", *order)
    written = materialize(
        ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), block_bits)), name
    )
    summaries = written.groupBy("list_id", "block").agg(*summary)
    summaries = summaries.withColumn("_part", F.shiftright("block", ROW_BITS - block_bits))
    # a list's blocks in one partition have consecutive numbers
    parts = summaries.groupBy("list_id", "_part").agg(
        F.min("block").alias("_first"), F.count(F.lit(1)).alias("_blocks")
    )
    earlier = Window.partitionBy("list_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_blocks").over(earlier), F.lit(0)))
    ranked = summaries.join(parts.drop("_blocks"), ["list_id", "_part"]).withColumn(
        "rank", F.col("_before") + F.col("block") - F.col("_first")
    )
    return Blocks(written, materialize(ranked.drop("_part", "_first", "_before"), f"{name}_blocks"))


def direct_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(DIRECT_CONF, str(DEFAULT_DIRECT_ROWS)))


def list_bounds(rows: DataFrame, order: list[Column], row_id: str, bound: dict[str, bool]) -> DataFrame:
    """``list_id`` and the columns ``bound``, as ``_at_<column>``, of a row some ``HEAD_ROWS`` down each
    list. Lists too short to have one are left out. A task passes on few rows of a list, however many
    it holds."""
    sampled = rows.filter(F.pmod(F.xxhash64("list_id", row_id), F.lit(BOUND_SAMPLE)) == 0)
    last = max(HEAD_ROWS // BOUND_SAMPLE, 1)
    place = F.row_number().over(Window.partitionBy("list_id").orderBy(*order))
    placed = sampled.select("list_id", *bound).withColumn("_place", place).filter(F.col("_place") <= last)
    return placed.filter(F.col("_place") == last).select("list_id", *[F.col(c).alias(f"_at_{c}") for c in bound])


def not_after(bound: dict[str, bool]) -> Column:
    """Whether a row stands at or before its bound, never NULL. ``bound``: the columns of the order,
    True where it rises (NULL first, NaN last) and False where it falls (the other way round)."""
    out = F.lit(True)
    for c, rising in reversed(bound.items()):
        own, at = F.col(c), F.col(f"_at_{c}")
        low, high = (own, at) if rising else (at, own)
        before = high.isNotNull() & (low.isNull() | (low < high))
        out = F.coalesce(before, F.lit(False)) | (own.eqNullSafe(at) & out)
    return out


def top_k(
    keys: DataFrame,
    key_id: str,
    rows: DataFrame,
    k: int,
    order: list[Column],
    summary: list[Column],
    may_pass: Column,
    passes: Callable[[DataFrame], DataFrame],
    row_id: str,
    bound: dict[str, bool] | None = None,
) -> FirstK:
    """``first_k`` over the blocks of ``rows`` (``list_id`` and others). Where all keys read
    their whole lists in ``direct_rows`` rows together, which is counted first, they do so:
    sorting the lists into blocks would cost more than it saves. ``bound``: the columns of ``order``
    (see ``not_after``); with them, and bounds that can be broadcast, heads are read first and only
    what is left of the lists is sorted."""
    rows = materialize(rows, "posting_rows")
    if _reads_whole_lists(keys, rows):
        return _direct(keys, key_id, rows, k, order, passes, row_id)
    bounds = None
    if bound is not None:
        bounds = materialize(list_bounds(rows, order, row_id, bound), "list_bounds")
        if relation_bytes(bounds) > dictionary_limit(rows.sparkSession):
            bounds = None
    if bounds is None:
        return first_k(keys, key_id, build(rows, order, summary), k, order, may_pass, passes)
    args = (k, order, summary, may_pass, passes, row_id)
    bounded = rows.join(F.broadcast(bounds.withColumn("_cut", F.lit(True))), "list_id", "left")
    inside = F.col("_cut").isNull() | not_after(bound)
    head = _direct_or_blocks(keys, key_id, bounded.filter(inside).select(*rows.columns), *args)
    counts = head.found.groupBy(key_id).agg(F.count(F.lit(1)).alias("_n"))
    # both sides have one row a key
    wanting = keys.join(counts, key_id, "left").filter(F.coalesce("_n", F.lit(0)) < k).drop("_n")
    wanting = materialize(wanting, "wanting")
    if wanting.isEmpty():
        return head
    behind = bounded.filter(~inside).select(*rows.columns)
    wanting = materialize(_may_find(wanting, key_id, behind, row_id, summary, may_pass), "wanting")
    if wanting.isEmpty():
        return head
    tail = _direct_or_blocks(wanting, key_id, _of_lists(behind, wanting, row_id), *args)
    best = Window.partitionBy(key_id).orderBy(*order)
    found = head.found.unionByName(tail.found).withColumn("place", F.row_number().over(best))
    return FirstK(materialize(found.filter(F.col("place") <= k), "first_rows"), head.reads + tail.reads)


def _of_lists(rows: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    """The rows of the lists of ``keys``."""
    lists = keys.select("list_id").distinct()
    return spread_join(rows, lists, ["list_id"], [row_id], "left_semi", written=True)


def _may_find(
    wanting: DataFrame, key_id: str, rows: DataFrame, row_id: str, summary: list[Column], may_pass: Column
) -> DataFrame:
    """The keys that the summary of all ``rows`` of their list does not rule out."""
    whole = _of_lists(rows, wanting, row_id).groupBy("list_id").agg(*summary)
    met = spread_join(wanting, whole, ["list_id"], [key_id], name="list_summaries")
    return met.filter(may_pass).select(*wanting.columns)


def _reads_whole_lists(keys: DataFrame, rows: DataFrame) -> bool:
    sizes = rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = keys.groupBy("list_id").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.join(wanted, "list_id").agg(F.sum(F.col("n") * F.col("m")).alias("n")).first()["n"] or 0
    return total <= direct_rows(rows.sparkSession)


def _direct(
    keys: DataFrame, key_id: str, rows: DataFrame, k: int, order: list[Column],
    passes: Callable[[DataFrame], DataFrame], row_id: str,
) -> FirstK:
    best = Window.partitionBy(key_id).orderBy(*order)
    read = spread_join(rows, keys, ["list_id"], [row_id], name="list_keys", written=True)
    found = passes(read).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return FirstK(materialize(found, "first_rows"))


def _direct_or_blocks(
    keys: DataFrame, key_id: str, rows: DataFrame, k: int, order: list[Column], summary: list[Column],
    may_pass: Column, passes: Callable[[DataFrame], DataFrame], row_id: str,
) -> FirstK:
    if _reads_whole_lists(keys, rows):
        return _direct(keys, key_id, rows, k, order, passes, row_id)
    return first_k(keys, key_id, build(rows, order, summary), k, order, may_pass, passes)


@dataclass
class FirstK:
    """``found``: the rows of each key, at most ``k``, with their ``place``. ``reads``: for every
    round the (key, block) pairs that it read."""

    found: DataFrame
    reads: list[DataFrame] = field(default_factory=list)


def first_k(
    keys: DataFrame,
    key_id: str,
    blocks: Blocks,
    k: int,
    order: list[Column],
    may_pass: Column,
    passes: Callable[[DataFrame], DataFrame],
) -> FirstK:
    """``keys``: ``key_id``, ``list_id`` and what the filters need, one row a key.
    ``may_pass``: over key and summary columns. ``passes``: the joined rows (key columns and
    row columns) that satisfy the key; it keeps ``key_id`` and the order's columns."""
    best = Window.partitionBy(key_id).orderBy(*order)
    wanting = keys.withColumn("_need", F.lit(k))
    summary_columns = [c for c in blocks.summaries.columns if c not in ("list_id", "block", "rank")]
    last = blocks.summaries.agg(F.max("rank").alias("rank")).first()["rank"]
    found: DataFrame | None = None
    reads: list[DataFrame] = []
    start, width = 0, FIRST_BLOCKS
    while True:
        own = blocks.summaries.filter((F.col("rank") >= start) & (F.col("rank") < start + width)).drop("rank")
        pairs = spread_join(wanting, own, ["list_id"], [key_id], name="block_summaries", written=True)
        pairs = materialize(pairs.filter(may_pass).drop(*summary_columns), "block_pairs")
        reads.append(pairs.select(key_id, "list_id", "block"))
        rows = blocks.rows
        row_columns = [c for c in rows.columns if c not in ("list_id", "block")]
        if start or (last or 0) >= width:  # else this round has all blocks
            wanted = own.select("list_id", "block")
            rows = spread_join(rows, wanted, ["list_id", "block"], row_columns, "left_semi", written=True)
        # few keys read many rows, or very many keys the same few
        read = meet(pairs, rows, ["list_id", "block"], [key_id], row_columns)
        top = passes(read).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
        found_now = materialize(top, "round_rows")
        found = found_now if found is None else found.unionByName(found_now)
        start, width = start + width, width * GROWTH
        if last is None or start > last:
            break
        counts = found_now.groupBy(key_id).agg(F.count(F.lit(1)).alias("_n"))
        # both sides have one row a key
        still = wanting.join(counts, key_id, "left").withColumn(
            "_need", F.col("_need") - F.coalesce("_n", F.lit(0))
        )
        wanting = materialize(still.filter(F.col("_need") > 0).drop("_n"), "wanting")
        if wanting.isEmpty():
            break
    if len(reads) > 1:  # a key's rows of several rounds, at most k of each
        found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
        found = materialize(found, "first_rows")
    return FirstK(found, reads)
