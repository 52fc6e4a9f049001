"""Dense positions 0..n-1 of a whole table in a given order.

``row_number()`` over a window without a partition key sorts the table in one task. Here the
rows are dealt to partitions by ranges of the order, sorted and numbered within each, and
written; the rows of each partition are counted, and a partition's first position is the sum
of the counts before it. Only these counts, one for each partition, reach the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.plans.sizing import materialize

# ``monotonically_increasing_id`` holds the partition above 33 bits of row number.
ROW_BITS = 33


def with_positions(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``df`` with the position (long, from 0) of each row in ``order``.

    ``order`` should end with columns that tell rows apart: rows equal in all of them get
    different positions, but which one gets which is open, and they lie in one partition."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = ranged.select(*[F.col(f"`{c}`") for c in df.columns], at.alias("_at"))
    numbered = materialize(numbered, "positions")
    part = F.shiftright("_at", ROW_BITS).cast("int")
    counts = numbered.groupBy(part.alias("part")).count().orderBy("part").collect()
    firsts = accumulate([r["count"] for r in counts], initial=0)
    starts = spark.createDataFrame(
        [(r.part, first) for r, first in zip(counts, firsts, strict=False)], "_part int, _first long"
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_first") + row).alias(name))
    )
