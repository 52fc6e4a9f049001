"""Deletion of line runs that occur earlier in the corpus (operator 2).

Winnowing over line hashes. Lines are compared without blanks at their ends;
lines without a word are passed over. A *run* is consecutive lines of one
document with at least ``min_words`` words together.

1. Window: from each line, the fewest lines onwards with ``min_words`` words.
   The window's smallest line hash (the last on ties) is a fingerprint. Equal
   runs hold equal windows, so they are guaranteed to share a fingerprint.
2. Fingerprints that occur at one place only are dropped; the others' positions
   are joined to their documents' line hashes.
3. Matches are extended both ways: around each such position, the windows that
   contain it, grown forwards from a line and backwards from a line, are
   compared by the hash of all their lines. Any line of a repeated run lies in
   a forward or backward window inside that run, so the windows cover exactly
   the repeated runs, without making a row for each pair of places.
4. A window that has an equal one earlier, by (doc_id, text hash, line), goes.

Documents are joined with the lines to delete (a broadcast if those were measured to
be small, a shuffle join otherwise); all else is hashes and positions. Frequent lines are counted with map-side partial results and joined
salted. Tables used twice are written to the shared checkpoint folder.

Defined cases: null text stays null, empty text stays empty; blank lines inside
a deleted run go with it; repeated rows (same id and text) are the same place and
keep their text; null ids come first; columns other than id and text pass
through ``deduplicate`` unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import table, texts, tidy
from dealgrid.llm.graph import salted_join
from dealgrid.plans.sizing import materialize, measured_broadcast

MIN_WORDS = 50
NULL_ID = -(1 << 63)


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the forward window of each line that has one."""
    out, total, end = [], 0, -1
    for start, own in enumerate(words):
        while total < min_words and end + 1 < len(words):
            end += 1
            total += words[end]
        if total < min_words:
            break
        out.append((start, end))
        total -= own
    return out


def winnow(hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions of the window minima."""
    low: deque[int] = deque()
    picked, taken = [], 0
    for start, end in windows(words, min_words):
        while taken <= end:
            while low and hashes[low[-1]] >= hashes[taken]:
                low.pop()
            low.append(taken)
            taken += 1
        while low[0] < start:
            low.popleft()
        if not picked or picked[-1] != low[0]:
            picked.append(low[0])
    return picked


def around(words: list[int], marks: list[int], min_words: int) -> list[tuple[int, int]]:
    """Forward and backward windows that contain a marked position."""
    n = len(words)
    back = [(n - 1 - e, n - 1 - s) for s, e in windows(words[::-1], min_words)]
    before = np.zeros(n + 1, np.int64)
    before[np.asarray(marks) + 1] = 1
    before = before.cumsum()
    both = set(windows(words, min_words)).union(back)
    return [(s, e) for s, e in both if before[e + 1] > before[s]]


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    import xxhash

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(text_col).alias("body"),
        F.col(text_col).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            all_hashes, all_words, all_at, all_marks, sizes = [], [], [], [], []
            for text in texts(batch, "text"):
                lines = text.split("\n")
                counts = [len(line.split()) for line in lines]
                at = [i for i, c in enumerate(counts) if c]
                words = [counts[i] for i in at]
                hashes = [digest(lines[i].strip().encode()) - (1 << 63) for i in at]
                all_hashes.append(hashes)
                all_words.append(words)
                all_at.append(at)
                all_marks.append(winnow(hashes, words, min_words))
                sizes.append(len(lines) if text else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(all_hashes, pa.list_(pa.int64())),
                    pa.array(all_words, pa.list_(pa.int32())),
                    pa.array(all_at, pa.list_(pa.int32())),
                    pa.array(all_marks, pa.list_(pa.int32())),
                ],
                ["doc", "body", "n_lines", "hashes", "words", "at", "marks"],
            )

    kind = "hashes array<long>, words array<int>, at array<int>, marks array<int>"
    return rows.mapInArrow(tidy(run), f"doc long, body long, n_lines long, {kind}")


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """doc, body, window (hash of its lines), first and last line number."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for doc, body, hashes, words, at, marks in zip(
                *(batch.column(c).to_pylist() for c in range(6)), strict=True
            ):
                raw = np.array(hashes, np.int64)
                out += [
                    (doc, body, digest(raw[s : e + 1].tobytes()) - (1 << 63), at[s], at[e])
                    for s, e in around(words, marks, min_words)
                ]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc", "body", "window", "low", "high"]
            )

    return rows.select("doc", "body", "hashes", "words", "at", "marks").mapInArrow(
        tidy(run), "doc long, body long, window long, low long, high long"
    )


def _flags(spans: DataFrame) -> DataFrame:
    """doc, body, gone: whether each line up to the last deleted one goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("spans").to_pylist():
                step = np.zeros(max(s["high"] for s in found) + 2, np.int32)
                np.add.at(step, [s["low"] for s in found], 1)
                np.add.at(step, [s["high"] + 1 for s in found], -1)
                rows.append(step.cumsum()[:-1] > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.bool_()))],
                ["doc", "body", "gone"],
            )

    return spans.mapInArrow(tidy(run), "doc long, body long, gone array<boolean>")


def deletions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``doc, body, gone`` of the documents that lose lines."""
    lines = materialize(_lines(docs, id_col, text_col, min_words), "lines")
    marks = lines.select(
        "doc", "body", F.explode(F.transform("marks", lambda i: F.struct(
            i.alias("mark"), F.get("hashes", i).alias("hash")
        ))).alias("m")
    ).select("doc", "body", "m.*").distinct()
    repeated = marks.groupBy("hash").agg(F.count("*").alias("places")).filter("places > 1")
    found = salted_join(marks, repeated.select("hash"), "hash", F.col("doc"), "inner")
    candidates = found.groupBy("doc", "body").agg(F.collect_set("mark").alias("marks"))
    around_marks = lines.drop("marks").dropDuplicates(["doc", "body"]).join(
        candidates, ["doc", "body"]
    )
    places = materialize(_windows(around_marks, min_words), "windows")
    first = places.groupBy("window").agg(
        F.min(F.struct("doc", "body", "low")).alias("first"), F.count("*").alias("places")
    )
    first = first.filter("places > 1").select("window", "first")
    later = salted_join(places, first, "window", F.col("doc"), "inner").filter(
        F.struct("doc", "body", "low") != F.col("first")
    )
    spans = later.groupBy("doc", "body").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return _flags(spans)


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with the repeated runs deleted from ``text_col``, and
    ``_lines`` (lines before) and ``_gone`` (lines deleted)."""
    gone = deletions(docs, id_col, text_col, min_words)
    keyed = docs.withColumns(
        {
            "_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)),
            "_body": F.xxhash64(text_col),
        }
    )
    flags = gone.select(
        F.col("doc").alias("_doc"), F.col("body").alias("_body"), F.col("gone").alias("_flags")
    )
    joined = keyed.join(measured_broadcast(flags, "flags"), ["_doc", "_body"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.coalesce(F.get("_flags", i), F.lit(False)))
    deleted = F.size(F.filter(F.coalesce("_flags", F.array().cast("array<boolean>")), lambda x: x))
    text = F.when(F.col("_flags").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    size = F.when(F.coalesce(text_col, F.lit("")) == "", 0).otherwise(F.size(lines))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        size.cast("long").alias("_lines"),
        deleted.cast("long").alias("_gone"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_deleted"), "text"
    )


#: The definition: lines of windows (grown forwards or backwards to 50 words)
#: that have an equal window earlier.
SQL = r"""
WITH raw AS (
  SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l
  FROM documents),
line AS (
  SELECT doc_id, u.i AS i, trim(l[u.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM raw, unnest(range(1, len(l) + 1)) AS u(i)),
word AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\s]+')) AS n FROM line),
numbered AS (
  SELECT doc_id, i, line, row_number() OVER w AS k, sum(n) OVER w AS upto, n
  FROM word WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lists AS (
  SELECT doc_id, list(line ORDER BY k) AS lines, list(i ORDER BY k) AS pos FROM numbered GROUP BY doc_id),
spans AS (
  SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM numbered a JOIN numbered b USING (doc_id)
  WHERE b.k >= a.k AND b.upto - a.upto + a.n >= 50 GROUP BY a.doc_id, a.k
  UNION
  SELECT a.doc_id, max(b.k), a.k FROM numbered a JOIN numbered b USING (doc_id)
  WHERE b.k <= a.k AND a.upto - b.upto + b.n >= 50 GROUP BY a.doc_id, a.k),
named AS (
  SELECT doc_id, pos[s] AS low, pos[e] AS high, array_to_string(lines[s:e], chr(10)) AS body
  FROM spans JOIN lists USING (doc_id)),
later AS (
  SELECT doc_id, low, high FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, low) AS r FROM named) t
  WHERE r > 1),
gone AS (
  SELECT DISTINCT line.doc_id, line.i FROM line JOIN later USING (doc_id)
  WHERE line.i BETWEEN later.low AND later.high),
kept AS (
  SELECT doc_id, list(i) AS drop_at FROM gone GROUP BY doc_id)
SELECT raw.doc_id, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(coalesce(len(drop_at), 0) AS BIGINT) AS n_deleted,
  CASE WHEN drop_at IS NULL THEN text
       ELSE array_to_string([l[j] FOR j IN range(1, len(l) + 1) IF NOT list_contains(drop_at, j)], chr(10))
  END AS text
FROM raw LEFT JOIN kept USING (doc_id)
"""
