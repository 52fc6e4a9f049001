"""Byte-level BPE encoding and decoding (operator 1).

The text is cut by the vocabulary's pattern; each match is merged on its own.
A segment tree over the match's byte positions keeps, at the position where a
live symbol starts, the rank of the pair it forms with its live right
neighbour (none: infinite). The root is the leftmost pair of the lowest rank.
A merge changes three leaves, each in O(log n): the merged symbol, its left
neighbour, and the right one, which dies. A match of n bytes costs
O(n log n), so one 100,000-letter "word" is no trouble.

Spark partitions the documents; there is no shuffle. The vocabulary (a file of
50,256 ranks, under 1 MB: its size is fixed) is read on the driver and
broadcast, so that executors need no local copy. Matches repeat, so each
Python worker keeps the ids of up to ``MEMO_ENTRIES`` of them.

Defined cases: a null text is the empty text (no tokens); text that is no
UTF-8 is read with replacement characters; repeated rows give repeated
results; an empty table gives an empty result; only ``id`` and text columns are
read, so other columns cannot clash; an id outside the vocabulary raises
``KeyError`` in ``decode``; a byte without a rank raises ``KeyError``.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm.common import texts, tidy

INFINITE = 1 << 62
POSITION = (1 << 32) - 1
#: Bounds of a worker's memo (entries, and characters of one remembered part),
#: and characters of text taken at once.
MEMO_ENTRIES = 60_000
MEMO_CHARS = 64
AT_ONCE_CHARS = 150_000
#: Matches of up to so many bytes are merged many at once, so many at a time.
SHORT_BYTES = 64
PLACE_BITS = 7
SHORT_ROWS = 2_048


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one pattern match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def pair(i: int) -> int:
        j = end[i]
        if j >= n or end[j] - i > longest:
            return INFINITE
        rank = ranks.get(piece[i : end[j]])
        return INFINITE if rank is None else rank << 32 | i

    tree = [INFINITE] * (2 * size)
    tree[size : size + n] = map(pair, range(n))
    for p in range(size - 1, 0, -1):
        tree[p] = min(tree[2 * p], tree[2 * p + 1])

    def update(i: int, value: int) -> None:
        p = size + i
        tree[p] = value
        p >>= 1
        while p:
            low = min(tree[2 * p], tree[2 * p + 1])
            if tree[p] == low:
                return
            tree[p] = low
            p >>= 1

    while tree[1] != INFINITE:
        i = tree[1] & POSITION
        dead = end[i]
        end[i] = end[dead]
        if end[dead] < n:
            before[end[dead]] = i
        update(dead, INFINITE)
        update(i, pair(i))
        if before[i] >= 0:
            update(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ShortMerger:
    """The same merges for many short matches at once: row by row the segment
    tree of ``merge``, held in one array, one merge of every row a step."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, merged = array("q"), array("q")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        # a leaf is a rank and a position; 32 bits hold both for all but vast vocabularies
        self.kind = np.int32 if max(ranks.values(), default=0) < 1 << (31 - PLACE_BITS) else np.int64
        self.none = np.iinfo(self.kind).max
        self.leaves = (np.array(merged, np.int64)[order] << PLACE_BITS).astype(self.kind)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf at ``at``: rank and position of a pair of symbols (-1: none)."""
        key = left << 32 | right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (left >= 0) & (right >= 0) & (self.keys[slot] == key)
        return np.where(known, self.leaves[slot] | at.astype(self.kind), self.none)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of 2 to ``SHORT_BYTES`` bytes."""
        lengths = np.array([len(p) for p in pieces])
        size = 1 << int(lengths.max() - 1).bit_length()
        m, wide = len(pieces), size + 1
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8)
        symbol = self.byte[raw].reshape(m, wide)
        symbol[np.arange(wide) >= lengths[:, None]] = -1
        places = np.arange(size)
        tree = np.full((m, 2 * size), self.none, self.kind)
        tree[:, size:] = self._pair(symbol[:, :-1], symbol[:, 1:], places)
        for p in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * p], tree[:, 2 * p + 1], out=tree[:, p])
        after = np.minimum(np.tile(np.arange(1, wide + 1), (m, 1)), size)
        before = np.tile(np.arange(-1, size), (m, 1))
        symbol, tree = symbol.reshape(-1), tree.reshape(-1)
        after, before = after.reshape(-1), before.reshape(-1)
        live = np.arange(m)
        while True:
            root = tree[live * (2 * size) + 1]
            some = root < self.none
            live, root = live[some], root[some].astype(np.int64)
            if not len(live):
                break
            row, top = live * wide, live * (2 * size)
            i = root & (1 << PLACE_BITS) - 1
            dead = after[row + i]
            right = after[row + dead]
            symbol[row + i] = root >> PLACE_BITS
            symbol[row + dead] = -1
            after[row + i] = right
            before[row + right] = i
            left = before[row + i]
            ends = left < 0
            left[ends] = dead[ends]  # no left neighbour: the dead leaf once more
            tree[top + size + i] = self._pair(symbol[row + i], symbol[row + right], i)
            tree[top + size + left] = self._pair(symbol[row + left], symbol[row + i], left)
            tree[top + size + dead] = self.none
            nodes = [size + i, size + left, size + dead]
            for _ in range(size.bit_length() - 1):
                nodes = [p >> 1 for p in nodes]
                for p in nodes:
                    tree[top + p] = np.minimum(tree[top + 2 * p], tree[top + 2 * p + 1])
        symbol = symbol.reshape(m, wide)
        kept = symbol >= 0
        ids, stops = symbol[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
        starts = [0, *stops[:-1].tolist()]
        return [ids[a:b] for a, b in zip(starts, stops.tolist(), strict=True)]


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> ids of each as little-endian unsigned 32-bit integers.

    A single blank between two non-blanks always starts a match (every
    alternative of the pattern takes a blank only in front), so texts are cut
    there first, and each distinct part goes through pattern and merges once
    as long as a worker remembers it. Texts in which blanks touch other white
    space are cut by the pattern alone.
    """
    import regex

    find = regex.compile(pattern).findall
    uneven = regex.compile(r"\s |\s\s| \s|^\s|\s$").search
    longest = max(map(len, ranks), default=0)
    short = ShortMerger(ranks)
    memo: dict[str, bytes] = {}

    def cut(text: str) -> list[str]:
        if uneven(text):
            return find(text)
        head, *rest = text.split(" ")
        return [head, *[" " + part for part in rest]]

    def merged(pieces: set[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (rank := ranks.get(piece)) is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) > SHORT_BYTES:
                out[piece] = np.array(merge(piece, ranks, longest), "<u4").tobytes()
            else:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for same in by_size.values():
            for i in range(0, len(same), SHORT_ROWS):
                some = same[i : i + SHORT_ROWS]
                out.update(zip(some, short.merge(some), strict=True))
        return out

    def encode_some(some: list[str]) -> list[bytes]:
        parts = [cut(text) if text else [] for text in some]
        new = set().union(*parts).difference(memo)
        single: dict[str, bytes] = {}
        several: dict[str, list[bytes]] = {}
        for part in new:
            found = find(part)
            if len(found) == 1:
                single[part] = found[0].encode("utf-8")
            else:
                several[part] = [m.encode("utf-8") for m in found]
        ids = merged({*single.values(), *[m for found in several.values() for m in found]})
        for part, match in single.items():
            memo[part] = ids[match]
        for part, found in several.items():
            memo[part] = b"".join([ids[m] for m in found])
        out = [b"".join([memo[p] for p in row]) for row in parts]
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for part in new:
            if len(part) > MEMO_CHARS:
                memo.pop(part, None)
        return out

    def encode_texts(all_texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some: list[str] = []
        chars = 0
        for text in all_texts:
            some.append(text)
            chars += len(text)
            if chars >= AT_ONCE_CHARS:
                out += encode_some(some)
                some, chars = [], 0
        return out + encode_some(some)

    return encode_texts


def decoder(ranks: dict[bytes, int]) -> Callable[[bytes], bytes]:
    """packed ids -> the bytes they stand for."""
    token = {rank: raw for raw, rank in ranks.items()}.__getitem__
    return lambda packed: b"".join(map(token, np.frombuffer(packed, "<u4").tolist()))


def encode(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_decoded: bool = False,
) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``tokens`` (packed little-endian unsigned
    32-bit ids, the layout that training loaders map into memory) of every row;
    ``with_decoded`` adds ``decoded``, what ``decode`` makes of them, in the same pass
    (one Python worker a task instead of two)."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, decode_ids = encoder(ranks.value, pattern), decoder(ranks.value)
        for batch in batches:
            ids = encode_texts(list(texts(batch, "_text")))
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            if with_decoded:
                columns.append(pa.array(map(decode_ids, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "tokens", *["decoded"] * with_decoded]
    kind = rows.schema[id_col].dataType.simpleString()
    more = ", decoded binary" * with_decoded
    return rows.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens bigint, tokens binary{more}")


def decode(df: DataFrame, vocabulary: str, tokens_col: str = "tokens") -> DataFrame:
    """``df`` with ``decoded``: the bytes of the packed ids (null: empty)."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kept = [c for c in df.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = decoder(ranks.value)
        for batch in batches:
            out = [decode_ids(x or b"") for x in batch.column(tokens_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return df.select(*kept).mapInArrow(tidy(run), f"{schema}, decoded binary")


def digests(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Round trip of every text, as digests: doc_id, n_tokens, ids_sha256,
    decoded_sha256."""
    both = encode(docs, vocabulary, pattern, with_decoded=True)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
