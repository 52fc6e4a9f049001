"""Budgets without price lists.

Whether some price of a merchant lies in [lo, hi] needs the merchant's prices; a merchant
may have ten or ten million. Prices are cut into ``CELLS`` cells by a function that never
falls (``CELLS_PER_OCTAVE`` cells a doubling), and kept at three depths:

* ``words`` of a merchant: a bitmap of its occupied cells, in ``WORDS`` longs. A budget is a
  mask of the cells between those of its bounds (all prices there are inside) and one of its
  two edge cells. A common bit with the first settles the test, none with either too;
* ``cells``: lowest and highest price of each occupied cell of a merchant, formed for the
  edge cells that words leave open. They settle an edge cell, unless both bounds lie in the
  same cell and its prices reach over both;
* ``prices``: the distinct prices, by merchant and cell, for what is left.

The tables are aggregations over item rows, combined before their shuffle; no merchant's
prices are gathered in one row or task, and the joins are on merchant and cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.plans.sizing import materialize, relation_bytes
from dealgrid.plans.skew import dictionary_limit

CELLS_PER_OCTAVE = 16
WORD_BITS, WORDS = 64, 4
CELLS = WORD_BITS * WORDS


def cell_of(price: Column) -> Column:
    """Cell of a price; prices that rise never have falling cells."""
    scaled = F.log2(F.greatest(price, F.lit(0.0)) + 1) * CELLS_PER_OCTAVE
    return F.least(F.floor(scaled), F.lit(CELLS - 1)).cast("int")


def _bits(first: Column, last: Column, word: int) -> Column:
    """The cells ``first`` to ``last`` that fall into a word, as bits."""
    low = F.greatest(first, F.lit(word * WORD_BITS))
    high = F.least(last, F.lit((word + 1) * WORD_BITS - 1))
    ones = F.call_function(
        "shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(WORD_BITS - 1) - (high - low)).cast("int")
    )
    return F.when(low <= high, F.call_function("shiftleft", ones, (low - word * WORD_BITS).cast("int"))).otherwise(
        F.lit(0).cast("long")
    )


def budget_masks(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Words of the cells inside [lo, hi], and of its edge cells."""
    a, b = cell_of(lo), cell_of(hi)
    inside = F.array(*[_bits(a + 1, b - 1, w) for w in range(WORDS)])
    edges = F.array(*[_bits(a, a, w).bitwiseOR(_bits(b, b, w)) for w in range(WORDS)])
    return inside, edges


def common(left: Column, right: Column) -> Column:
    """Whether two arrays of words have a bit in common."""
    both = [left[w].bitwiseAND(right[w]) for w in range(WORDS)]
    out = both[0]
    for more in both[1:]:
        out = out.bitwiseOR(more)
    return out != 0


def either(words: Column) -> list[Column]:
    """Aggregates: the words that have a bit of any row's ``words``."""
    return [F.bit_or(words[w]) for w in range(WORDS)]


def _lowest_highest(prices: DataFrame) -> DataFrame:
    return prices.groupBy("merchant_id", "cell").agg(F.min("price").alias("low"), F.max("price").alias("high"))


@dataclass
class PriceCells:
    """``merchants``: ``merchant_id, pmin, pmax, words``. ``cells``: ``merchant_id, cell, low,
    high``. ``prices``: ``merchant_id, cell, price``. Cells and prices are not written."""

    merchants: DataFrame
    cells: DataFrame
    prices: DataFrame
    written: DataFrame | None = None

    def among(self, wanted: DataFrame) -> DataFrame:
        """The cells among ``wanted`` (``merchant_id, cell``), or all: where the wanted ones can be
        broadcast, other prices are not grouped; else all cells are written, once."""
        if self.written is None:
            wanted = materialize(wanted.distinct(), "wanted_cells")
            if relation_bytes(wanted) <= dictionary_limit(wanted.sparkSession):
                return _lowest_highest(self.prices.join(F.broadcast(wanted), ["merchant_id", "cell"], "left_semi"))
            self.written = materialize(self.cells, "price_cells")
        return self.written


def price_cells(priced: DataFrame) -> PriceCells:
    """``priced``: ``merchant_id, dp``, the valid prices (null and NaN are left out)."""
    prices = priced.filter(F.col("dp").isNotNull() & ~F.isnan("dp")).select(
        "merchant_id", cell_of(F.col("dp")).alias("cell"), F.col("dp").alias("price")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell") % WORD_BITS)
    word = (F.col("cell") / WORD_BITS).cast("int")
    merchants = prices.groupBy("merchant_id").agg(
        F.min("price").alias("pmin"),
        F.max("price").alias("pmax"),
        F.array(
            *[F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0).cast("long")) for w in range(WORDS)]
        ).alias("words"),
    )
    return PriceCells(merchants, _lowest_highest(prices), prices)


def verdict(lo: Column, hi: Column, inside: Column, edges: Column) -> Column:
    """Whether a merchant (``pmin, pmax, words``) has a price in [lo, hi]; NULL if only its cells
    can tell."""
    pmin, pmax, words = F.col("pmin"), F.col("pmax"), F.col("words")
    return (
        F.when(F.isnan(lo) | F.isnan(hi) | (pmax < lo) | (pmin > hi), F.lit(False))
        .when((hi == float("inf")) | (lo <= pmin) | (pmax <= hi), F.lit(True))
        .when(common(words, inside), F.lit(True))
        .when(~common(words, edges), F.lit(False))
    )


def settle(unsure: DataFrame, found: PriceCells) -> DataFrame:
    """The rows of ``unsure`` (with ``merchant_id, lo, hi`` and distinct otherwise) whose merchant
    has a price in the budget."""
    columns = unsure.columns
    lo, hi = F.col("lo"), F.col("hi")
    a, b = cell_of(lo), cell_of(hi)
    edge = unsure.withColumn("cell", F.explode(F.array_distinct(F.array(a, b))))
    inside = lambda p: (p >= lo) & (p <= hi)
    ends = inside(F.col("low")) | inside(F.col("high"))
    across = (F.col("low") < lo) & (F.col("high") > hi)
    cells = found.among(edge.select("merchant_id", "cell"))
    seen = edge.join(cells, ["merchant_id", "cell"]).filter(ends | across)
    seen = materialize(seen.withColumn("sure", ends).drop("low", "high"), "price_edges")
    sure, deep = seen.filter("sure").select(*columns), seen.filter("not sure")
    if not deep.isEmpty():
        priced = deep.join(found.prices, ["merchant_id", "cell"]).filter(inside(F.col("price")))
        sure = sure.unionByName(priced.select(*columns))
    return sure.distinct()
