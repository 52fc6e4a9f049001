"""Language-model scores from a log-frequency Bloom filter (operator 7).

Learning, one pass over the training texts: tokens are hashed by Spark; tasks
count the 1- to ``ORDER``-grams of each Arrow batch and send them as sorted packed
blocks to *segments*, ranges of the key hash. There are about as many segments
as millions of n-grams, so what one group holds does not grow with the corpus,
and a frequent n-gram arrives once per batch. A segment adds up its counts c,
quantises them to levels 1 + floor(log2 c), and inserts each n-gram once for each
of its levels into its own part of the filter (``BITS`` bits an insertion,
``PROBES`` hash functions). Exact counts of single tokens leave with it.

Scoring: the filter is broadcast. An n-gram is probed at level 1, 2, ... until a
probe fails; the mid-point of the last level's range is its count. Probabilities
are smoothed by interpolation: p(w | v) = L c(vw) / c(v) + (1 - L) (c(w) + 1) / (N + V + 1).

Bounds: the filter takes 1 byte an insertion at every size, so that false positives
stay at about 2.4 %. What is broadcast at once are segments of ``MOST_BYTES``
together. A larger filter is used in several passes: each probes the n-grams of its
segments, and writes the tokens with the levels found so far for the next one; the
last scores. The base score needs exact counts of all words: the ``HEAD_WORDS`` most
frequent are broadcast, tokens outside them meet the rest of the vocabulary in a
shuffle join, in which no word is frequent.

Defined cases: null text is empty and has the end token only; repeated rows have
equal scores, and count twice when learned from; null ids count as training rows;
without training rows counts are 0; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import (
    ascii_lower,
    give_back,
    id_remainder,
    list_column,
    mix,
    row_numbers,
    split_words,
    table,
    tidy,
    whole_text,
    word_hashes,
)
from dealgrid.plans.sizing import materialize

ORDER = 2
BITS, PROBES = 8, 4
#: Bytes of the filter that a scoring pass broadcasts.
MOST_BYTES = 96 << 20
SEGMENT_NGRAMS = 1_000_000
HEAD_WORDS = 400_000
WEIGHT = 0.4
#: Tokens counted and scored at once in a task.
COUNT_AT_ONCE, SCORE_AT_ONCE = 1_000_000, 100_000
#: A token that holds a blank, so no word is equal to it.
END = " end"


def tokens(text: Column) -> Column:
    """Hashes of the words and the end."""
    words = split_words(ascii_lower(whole_text(text)))
    return F.concat(word_hashes(words), F.array(F.xxhash64(F.lit(END))))


def keys(flat: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each token; before a text lie ends of text,
    that is, its own last token."""
    key = np.full(len(flat), order, np.uint64)
    row = row_numbers(at)
    place = np.arange(len(flat))
    for back in range(order - 1, -1, -1):
        from_ = place - back
        before = from_ < at[row]
        part = flat[np.where(before, at[row + 1] - 1, from_)]
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    """Monotone in the key: sorted keys have sorted segments."""
    return ((key >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]


def count_at(level: np.ndarray) -> np.ndarray:
    """The mid-point of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level.astype(float)) - 1) / 2, 0.0)


def _bit_places(key: np.ndarray, level: int | np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    salted = mix(key + np.asarray(level, np.uint64) * np.uint64(0xD1342543DE82EF95))
    first, step = salted >> np.uint64(32), (salted & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step) % np.asarray(bits, np.uint64)


def insert(key: np.ndarray, level: np.ndarray, most_bytes: float = math.inf) -> np.ndarray:
    """The filter of one segment, as bytes of 8 bits."""
    size = int(max(8, min(math.ceil(level.sum() * BITS / 8), most_bytes)))
    mark = np.zeros(size * 8, bool)
    for at_level in range(1, int(level.max(initial=0)) + 1):
        for place in _bit_places(key[level >= at_level], at_level, size * 8):
            mark[place.astype(np.int64)] = True
    return np.packbits(mark, bitorder="little")


@dataclass
class Filter:
    """Segments' filters end to end; ``start`` has one byte position more."""

    data: np.ndarray
    start: np.ndarray

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The highest level up to which all probes succeed."""
        out = np.zeros(len(key), np.int64)
        if len(self.start) < 2 or not len(self.data):
            return out
        segment = segment_of(key, len(self.start) - 1)
        base, bits = self.start[segment], 8 * (self.start[segment + 1] - self.start[segment])
        live = np.flatnonzero(bits > 0)
        for level in range(1, 64):
            places = _bit_places(key[live], level, bits[live])
            still = np.ones(len(live), bool)
            for place in places:
                place = place.astype(np.int64)
                byte = self.data[base[live] + (place >> 3)]
                still &= (byte >> (place & 7).astype(np.uint8)) & 1 == 1
            live = live[still]
            if not len(live):
                break
            out[live] = level
        return out


def _pieces(at: np.ndarray, tokens_at_once: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many tokens."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + tokens_at_once, "left"))
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def _counted(train: DataFrame, segments: int) -> DataFrame:
    """order, segment, packed keys and counts, of each piece of each batch. Order
    0 are the token hashes themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = list_column(batch, "h")
            flat = flat.view(np.uint64)
            for first, last in _pieces(at, COUNT_AT_ONCE):
                part, cut = flat[at[first] : at[last]], at[first : last + 1] - at[first]
                rows: list[tuple] = []
                for order in range(ORDER + 1):
                    key = keys(part, cut, order) if order else part
                    key, n = np.unique(key, return_counts=True)
                    edge = np.searchsorted(segment_of(key, segments), np.arange(segments + 1))
                    n = n.astype(np.uint32)
                    rows += [
                        (order, s, key[a:b].tobytes(), n[a:b].tobytes())
                        for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))
                        if b > a
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.binary()),
                        pa.array([r[3] for r in rows], pa.binary()),
                    ],
                    ["order", "segment", "keys", "counts"],
                )

    return train.select("h").mapInArrow(tidy(run), "order int, segment long, keys binary, counts binary")


def _packed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values that a column of binaries holds, end to end; read from its buffers."""
    parts = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk):
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(parts or [np.empty(0, np.uint8)]).view(kind)


def learn(train: DataFrame, segments: int) -> DataFrame:
    """One row a segment: its filter, and the hashes and counts of its tokens.
    ``train`` has token hashes ``h``."""

    def total(group: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
        own = group.filter(pa.compute.equal(group.column("order"), order))
        key, n = _packed(own.column("keys"), np.uint64), _packed(own.column("counts"), np.uint32)
        if not len(key):
            return key, n.astype(np.int64)
        places = np.argsort(key, kind="stable")
        key, n = key[places], n[places]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[edge], np.add.reduceat(n, edge, dtype=np.int64)

    def build(group: pa.Table) -> pa.Table:
        words, counts = total(group, 0)
        grams = [total(group, order) for order in range(1, ORDER + 1)]
        key = np.concatenate([g[0] for g in grams])
        level = levels_of(np.concatenate([g[1] for g in grams]))
        out = pa.table(
            {
                "segment": group.column("segment").slice(0, 1),
                "bits": pa.array([insert(key, level).tobytes()], pa.binary()),
                "tokens": [int(counts.sum())],
                "types": [len(words)],
                "words": pa.array([words.view(np.int64)], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
            }
        )
        del group, words, counts, grams, key, level
        give_back()
        return out

    kind = "segment long, bits binary, tokens long, types long, words array<long>, counts array<long>"
    return _counted(train, segments).groupBy("segment").applyInArrow(build, kind)


def passes(sizes: list[int], most_bytes: int) -> list[tuple[int, int]]:
    """Ranges of segments of at most so many bytes together, or of one segment."""
    out, first = [], 0
    for last in range(1, len(sizes) + 1):
        if last == len(sizes) or sum(sizes[first : last + 1]) > most_bytes:
            out.append((first, last))
            first = last
    return out


def _filter_of(model: DataFrame, segments: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Data and starts of a filter in which only the segments of the range have bits."""
    parts = [np.empty(0, np.uint8)] * segments
    own = model.filter((F.col("segment") >= first) & (F.col("segment") < last))
    for row in own.select("segment", "bits").toArrow().to_pylist():
        parts[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _levels(
    bloom: Filter, flat: np.ndarray, at: np.ndarray, word: np.ndarray, inverse: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the 1- and the 2-gram that end at each token."""
    one = mix(np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))  # keys() of order 1
    return bloom.levels(one)[inverse], bloom.levels(keys(flat.view(np.uint64), at, 2))


def _so_far(batch: pa.RecordBatch, first: int, last: int) -> list[np.ndarray]:
    """The levels that earlier passes found; an n-gram is in one segment, so levels add up."""
    return [
        np.frombuffer(b"".join(batch.column(c).slice(first, last - first).to_pylist()), np.uint8).astype(np.int64)
        for c in ("ones", "twos")
    ]


def _probed(tokens: DataFrame, shared: Broadcast, id_col: str) -> DataFrame:
    """``tokens`` with the levels of the n-grams in the shared segments added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Filter(*shared.value)
        for batch in batches:
            all_flat, all_at = list_column(batch, "h")
            for first, last in _pieces(all_at, SCORE_AT_ONCE):
                flat = all_flat[all_at[first] : all_at[last]]
                at = all_at[first : last + 1] - all_at[first]
                found = _levels(bloom, flat, at, *np.unique(flat, return_inverse=True))
                if "ones" in batch.schema.names:
                    found = [a + b for a, b in zip(found, _so_far(batch, first, last), strict=True)]
                offsets = pa.py_buffer(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, last - first) for i in range(3)]
                    + [
                        pa.Array.from_buffers(
                            pa.binary(), last - first, [None, offsets, pa.py_buffer(f.astype(np.uint8))]
                        )
                        for f in found
                    ],
                    [id_col, "body", "h", "ones", "twos"],
                )

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.mapInArrow(tidy(run), f"`{id_col}` {kind}, body long, h array<long>, ones binary, twos binary")


def _remove(written: DataFrame) -> None:
    """Deletes a written table that is not read any more."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def head_count(vocabulary: DataFrame, most_words: int) -> int:
    """The least count, a power of two, that at most ``most_words`` words reach."""
    by_level = vocabulary.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()
    room = most_words
    for row in sorted(by_level, key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            return 2 ** (row["level"] + 1)
    return 1


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row of
    ``docs``; learned from the rows where ``train`` holds."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    segments = max(1, math.ceil(size * ORDER / 6 / SEGMENT_NGRAMS))
    hashed = docs.select(
        F.col(id_col), F.xxhash64(text_col).alias("body"), tokens(F.col(text_col)).alias("h"), train.alias("train")
    )
    model = materialize(learn(hashed.filter("train"), segments), "language_model")
    known = model.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_train, n_types = known["n"] or 0, known["v"] or 0
    denominator = n_train + n_types + 1

    vocabulary = model.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(
        F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    least = head_count(vocabulary, HEAD_WORDS)
    head = vocabulary.filter(F.col("n") >= least).toPandas().sort_values("word")
    sizes = [0] * segments
    for row in model.select("segment", F.octet_length("bits").alias("n")).collect():
        sizes[row["segment"]] = row["n"]
    *earlier, final = passes(sizes, MOST_BYTES)
    probed = hashed.select(id_col, "body", "h")
    for k, (first, last) in enumerate(earlier):
        part = spark.sparkContext.broadcast(_filter_of(model, segments, first, last))
        before, probed = probed, materialize(_probed(probed, part, id_col), "levels")
        part.destroy()
        if k:
            _remove(before)
    shared = spark.sparkContext.broadcast(
        (*_filter_of(model, segments, *final), head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64))
    )
    del head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, words, counts = shared.value
        bloom = Filter(data, starts)
        logs = np.log10(counts + 1.0)
        for batch in batches:
            all_flat, all_at = list_column(batch, "h")
            for first, last in _pieces(all_at, SCORE_AT_ONCE):
                flat = all_flat[all_at[first] : all_at[last]]
                at = all_at[first : last + 1] - all_at[first]
                word, inverse = np.unique(flat, return_inverse=True)
                found = np.zeros(len(word), bool)
                base = np.zeros(len(word))
                if len(words):
                    slot = np.minimum(np.searchsorted(words, word), len(words) - 1)
                    found = words[slot] == word
                    base[found] = logs[slot[found]]
                levels = _levels(bloom, flat, at, word, inverse)
                if earlier:
                    levels = [a + b for a, b in zip(levels, _so_far(batch, first, last), strict=True)]
                single, pair = map(count_at, levels)
                flat = flat.view(np.uint64)
                before = np.roll(single, 1)
                before[at[:-1]] = single[at[1:] - 1]
                share = pair / np.maximum(np.maximum(before, pair), 1)
                p = WEIGHT * share + (1 - WEIGHT) * (single + 1) / denominator
                sums = lambda x, cut=at: np.add.reduceat(x, cut[:-1])  # noqa: E731  no text is without a token
                rest = ~found[inverse] if least > 1 else np.zeros(len(flat), bool)
                cut = np.concatenate([[0], np.cumsum(sums(rest.astype(np.int64)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(sums(found[inverse].astype(np.int64))),
                        pa.array(sums(base[inverse])),
                        pa.array(sums(np.log10(p))),
                        pa.ListArray.from_arrays(
                            pa.array(cut, pa.int32()), pa.array(flat[rest].view(np.int64))
                        ),
                    ],
                    [id_col, "body", "n_tokens", "known", "logs", "score", "rest"],
                )

    kind = hashed.schema[id_col].dataType.simpleString()
    scored = materialize(
        probed.mapInArrow(
            tidy(run),
            f"`{id_col}` {kind}, body long, n_tokens long, known long, logs double, score double, rest array<long>",
        ),
        "scores",
    )
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key")
    rare = scored.filter(F.size("rest") > 0).select(key, "body", "rest").dropDuplicates(["_key", "body"])
    rare = rare.select("_key", "body", F.explode("rest").alias("word")).join(
        vocabulary.filter(F.col("n") < least), "word"
    )
    rare = rare.groupBy("_key", "body").agg(
        F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_logs")
    )
    if earlier:
        _remove(probed)
    both = scored.drop("rest").withColumn("_key", key).join(rare, ["_key", "body"], "left")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return both.select(
        id_col,
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * math.log10(denominator)).alias("base_score"),
        "score",
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_remainder(F.col(doc_id), 7) == 2, F.lit(False))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out())
    return scored.withColumn("held_out", held_out())
