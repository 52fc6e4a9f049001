"""Column expressions and Arrow helpers shared by the text operators.

Word rules: ``split_words`` is the contract's ``[^\\x20\\x09-\\x0D]+`` and
``ascii_lower`` lower-cases A-Z only. Nulls count as empty text everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column) -> Column:
    """The words of ``text`` (not null) between blanks, as array<string>."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[ \x09-\x0D]+")
    )


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def list_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a list column without null rows."""
    col = batch.column(name)
    offsets = col.offsets.to_numpy()
    values = col.values
    if values.null_count:
        raise ValueError(f"null element in {name}")
    return values.to_numpy(zero_copy_only=False), offsets


def give_back() -> None:
    """Returns the memory that this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task's function, after which the Python worker gives memory back:
    workers are used again, and would else keep what a task needed at its height."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of any object of this subpackage: its classes go along by value, so that
    executors need no installed copy."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def decoded(raw: pa.Array) -> Iterator[str]:
    """Texts of a binary array (text cast to binary, so that bytes which are no
    UTF-8 become the replacement character instead of an error)."""
    for value in raw.to_pylist():
        yield "" if value is None else value.decode("utf-8", errors="replace")


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    return decoded(batch.column(name))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_numbers(offsets: np.ndarray) -> np.ndarray:
    """The row of each value of a list column."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
