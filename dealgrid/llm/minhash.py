"""Near-duplicate documents by b-bit MinHash (operator 8).

1. Words (A-Z lower-cased) are hashed by Spark; Arrow batches of hash lists
   become sets of word shingles, ``PERMUTATIONS`` minima each. The low
   ``BITS`` bits of the minima are packed; groups of ``ROWS`` whole minima are
   hashed to band keys. Equal sets share a digest and are one node, its id the
   smallest doc_id, so thousands of exact copies cost nothing later. Nodes with one
   id are told apart by ``version``, a hash of the digest.
2. Candidates: nodes that share a band key. At a Jaccard similarity of 0.8 a
   pair shares no band with probability (1 - 0.8^4)^32 < 5e-8. Every node is tied to
   the smallest node of each of its buckets (as many ties as nodes, however large
   the bucket); the components of the ties are *families*, outside which no
   pair shares a band. A family of more than ``MOST_FAMILY`` nodes is compared bucket
   by bucket instead, so that a chain of chance ties cannot make one huge group.
3. Groups are compared in pairs of parts of about ``BLOCK`` nodes (or
   ``BLOCK_SHINGLES`` shingles) each, whole sets at hand.
   A pair is looked at only while its nodes are not yet connected inside the block,
   fits in size, and is estimated, by counting equal bits and correcting for
   chance, to lie at most ``DEVIATIONS`` standard deviations under the threshold; it
   is a link only if its full sets confirm it. A block returns a spanning forest of
   its links: no link between different components is lost, and the rows
   returned are fewer than the nodes.
4. Components of the links are numbered by their smallest doc_id.

Hot groups: equal sets are aggregated by digest with map-side partial results,
joins with hot buckets and hubs are salted, blocks bound what a task compares at
once. Intermediate tables are written to the shared checkpoint folder.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; texts of fewer words than a shingle are one shingle; ties take the
smaller doc_id; rows with a null doc_id are returned unlinked (component null,
kept); rows which share a doc_id and a set are the same document; rows which share
a doc_id and have different sets are versions of one document, and what is linked with
any version is linked with all; columns other than id and text are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import (
    ascii_lower,
    list_column,
    mix,
    split_words,
    table,
    tidy,
    whole_text,
    word_hashes,
)
from dealgrid.llm.graph import components, salted_join, stored
from dealgrid.plans.sizing import materialize, measured_broadcast

PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
DEVIATIONS = 6
#: A part of a group holds about so many nodes and shingles.
BLOCK, BLOCK_SHINGLES = 512, 200_000
MOST_FAMILY = 20_000

_draw = np.random.Generator(np.random.PCG64(8))
FACTORS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the word hashes of one document."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    used = min(width, len(words))
    out = np.full(n, used, np.uint64)
    for k in range(used):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512]
        np.minimum(low, (FACTORS[:, None] * part + SHIFTS[:, None]).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> bytes:
    """The low ``BITS`` bits of the minima, two of them a byte."""
    kept = (mix(low) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (kept[0::2] << BITS | kept[1::2]).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


#: For two packed minima in a byte: how many of them are equal, by their XOR.
EQUAL = np.array([(x >> BITS == 0) + (x & (1 << BITS) - 1 == 0) for x in range(256)], np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures (last axis: bytes),
    corrected for minima that agree in their low bits by chance."""
    equal = EQUAL[a ^ b].sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * threshold
    spread = math.sqrt(agree * (1 - agree) / PERMUTATIONS) / (1 - chance)
    return threshold - DEVIATIONS * spread


def _version() -> Column:
    return F.xxhash64("digest").alias("version")


def _versions(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """``u, v``: every doc_id with several sets, tied to the nodes of them."""
    several = whole.groupBy("doc_id").agg(
        F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")
    )
    several = measured_broadcast(several.filter("low <> high").select("doc_id"), "several_sets")
    rows = whole.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct()
    return (
        rows.join(classes.select("digest", "node"), "digest")
        .filter("doc_id <> node")
        .select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    )


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(whole_text(F.col(text_col)))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), word_hashes(split_words(text)).alias("h")
    )


def _signatures(hashed: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = list_column(batch, "h")
            flat = flat.view(np.uint64)
            sizes, digests, packed, bands = [], [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                found = shingle_set(flat[a:b], width)
                sizes.append(len(found))
                if not len(found):
                    digests.append(None)
                    packed.append(None)
                    bands.append(None)
                    continue
                low = minima(found)
                digests.append(set_digest(found))
                packed.append(pack(low))
                bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(packed, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "sig", "bands"],
            )

    kind = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"
    return hashed.mapInArrow(tidy(run), kind)


def _sets(hashed: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = list_column(batch, "h")
            flat = flat.view(np.uint64)
            rows = [shingle_set(flat[a:b], width) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([set_digest(r) for r in rows], pa.binary()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                ["node", "digest", "shingles"],
            )

    out = hashed.mapInArrow(tidy(run), "node long, digest binary, shingles binary")
    return out.select("node", _version(), "shingles").dropDuplicates(["node", "version"])


def confirmed(
    node: np.ndarray, side: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, across: bool
) -> list[tuple[int, int]]:
    """A spanning forest of the links among the nodes of a block (``across``: only
    between its two sides)."""
    n = np.array([len(s) for s in sets])
    least = least_estimate(percent / 100)
    # rows of each shingle, to intersect one set with all others at once
    shingle, flat = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    rows_of, first = row[order], np.searchsorted(flat[order], np.arange(len(shingle) + 1))
    own = np.split(flat, np.cumsum(n)[:-1])
    label = np.arange(len(node))
    links = []
    # sets alike to most others first: they connect the most nodes
    usual = np.diff(first)
    weight = np.array([usual[o].mean() for o in own])
    for i in np.argsort(-weight, kind="stable"):
        small, large = np.minimum(n, n[i]), np.maximum(n, n[i])
        open_ = (label != label[i]) & (100 * small >= percent * large)
        if across:
            open_ &= side != side[i]
        where = np.flatnonzero(open_)
        where = where[similarity(sig[where], sig[i]) >= least]
        if not len(where):
            continue
        hits = np.concatenate([rows_of[first[k] : first[k + 1]] for k in own[i]])
        common = np.bincount(hits, minlength=len(node))[where]
        for j in where[100 * common >= percent * (n[where] + n[i] - common)]:
            if label[j] != label[i]:
                links.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return links


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links of all blocks. ``rows``: block, across, side, node, sig, shingles; a
    block's rows lie side by side in a partition."""

    def of(block: list[dict]) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(r["sig"] for r in block), np.uint8).reshape(len(block), -1)
        found = confirmed(
            np.array([r["node"] for r in block]),
            np.array([r["side"] for r in block]),
            sig,
            [np.frombuffer(r["shingles"], np.uint64) for r in block],
            percent,
            block[0]["across"],
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([max(pair) for pair in found], pa.int64()),
                pa.array([min(pair) for pair in found], pa.int64()),
            ],
            ["u", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if block and block[0]["block"] != row["block"]:
                    yield of(block)
                    block = []
                block.append(row)
        if block:
            yield of(block)

    return rows.mapInArrow(tidy(run), "u long, v long")


def link(
    docs: DataFrame,
    width: int,
    percent: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: documents are
    linked when 100 * |A and B| >= percent * |A or B| of their shingle sets."""
    hashed = _hashed(docs, id_col, text_col)
    sigs = materialize(_signatures(hashed, width), "signatures")
    rows = sigs.count()
    whole = sigs.filter("doc_id is not null and digest is not null")

    classes = whole.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies")
    )
    classes = stored(classes, "classes", rows)
    nodes = whole.join(
        classes.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi"
    ).dropDuplicates(["doc_id", "digest"])
    nodes = nodes.select(
        F.col("doc_id").alias("node"), _version(), F.col("n_shingles").alias("n"), "sig", "bands"
    )
    nodes = stored(nodes, "nodes", rows)

    # a bucket: the nodes that share a band key; its hub: the smallest of them
    member = nodes.select("node", "version", "n", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    buckets = buckets.filter("last > hub").select("bucket", "hub")
    member = stored(
        salted_join(member, buckets, "bucket", F.col("version"), "inner"), "members", BANDS * rows
    )
    ties = member.filter("node > hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    families = components(ties, BANDS * rows).withColumnRenamed("component", "family")
    families = families.join(nodes.select("node", "version", "n"), "node")
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))
    families = salted_join(families, sizes, "family", F.col("version"), "inner")
    families = stored(families, "families", rows)

    grouped = families.filter(F.col("size") <= MOST_FAMILY).select(
        "node", "version", "n", F.col("family").alias("group"), F.lit(False).alias("bucketed")
    )
    wide = families.filter(F.col("size") > MOST_FAMILY).select("node")
    grouped = grouped.unionByName(
        member.join(wide, "node", "left_semi").select(
            "node", "version", "n", F.col("bucket").alias("group"), F.lit(True).alias("bucketed")
        )
    )
    counts = grouped.groupBy("group", "bucketed").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
        .cast("int")
        .alias("parts")
    )
    blocks = (
        salted_join(grouped, counts, ["group", "bucketed"], F.col("version"), "inner")
        .withColumn("side", F.pmod(F.xxhash64("node", "version"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    blocks = blocks.select(
        F.xxhash64(
            "group", "bucketed", F.least("side", "other"), F.greatest("side", "other")
        ).alias("block"),
        "side",
        (F.col("side") != F.col("other")).alias("across"),
        "node",
        "version",
    )
    near = measured_broadcast(families.select(F.col("node").alias("doc_id")), "candidates")
    some = docs.withColumn("_id", F.col(id_col).cast("long")).join(
        near.withColumnRenamed("doc_id", "_id"), "_id", "left_semi"
    )
    sets = _sets(_hashed(some, "_id", text_col), width)
    signed = nodes.join(sets, ["node", "version"]).select("node", "version", "sig", "shingles")
    compared = blocks.join(materialize(signed, "shingle_sets"), ["node", "version"])
    links = _links(compared.repartition("block").sortWithinPartitions("block"), percent)
    links = materialize(links.unionByName(_versions(whole, classes)), "links")
    linked = components(links, links.count())

    of_class = classes.join(linked, "node", "left").filter("copies > 1 or component is not null")
    of_class = of_class.select("digest", F.coalesce("component", "node").alias("component"))
    out = salted_join(
        sigs.select("doc_id", "n_shingles", "digest"), of_class, "digest", F.col("doc_id"), "left"
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), width=4, percent=80)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON least.u = sets.doc_id
"""
