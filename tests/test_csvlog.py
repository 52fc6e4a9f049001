"""CSV logs read in splits: records over lines, headers of their own, edge cases."""

from __future__ import annotations

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from dealgrid.sources import convlog, csvlog

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in (SPLIT, OPEN_COST)}
    spark.conf.set(SPLIT, "300")
    spark.conf.set(OPEN_COST, "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(n: int, seed: int) -> list[list[str]]:
    draw = random.Random(seed)
    parts = ["plain", '"', ",", "\n", "\n\n", "\r\n", " é東 ", '{"a": [1, "b"]}', '""', "x" * 400]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(1, 6)))
    return [[f"t{k:05d}", str(k), text(), text(), text(), f"[{k}, {k + 1}]"] for k in range(n)]


def _write(path: str, header: list[str], rows: list, end: str = "\n", mark: str = "") -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(mark)
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_splits(spark, scratch, small_splits, end):
    """A file of many splits, records and quotes across their borders: as Python's reader
    gives it."""
    rows = _rows(300, 5)
    path = os.path.join(scratch, "log.csv")
    _write(path, list(convlog.LOG_COLUMNS), rows, end, mark="﻿")
    assert spark.read.text(path).select("_metadata.file_block_start").distinct().count() > 20
    found = [list(r) for r in csvlog.history(spark, path).collect()]
    assert found == rows
    numbers = csvlog.records(spark, path).agg(F.count("*"), F.countDistinct("record"), F.max("record"))
    assert tuple(numbers.first()) == (301, 301, 300)


def test_files_with_their_own_headers(spark, scratch):
    _write(os.path.join(scratch, "old.csv"), ["customer_id", "timestamp", "extra, quoted"],
           [["1", "t1", "e"], ["2", "t2", "f,\ng"]])
    _write(os.path.join(scratch, "new.csv"), list(convlog.LOG_COLUMNS),
           [["t3", "3", "a\nb", "{}", "o", "[1]"], ["t4", "4"]])
    open(os.path.join(scratch, "empty.csv"), "w").close()
    rows = [tuple(r) for r in csvlog.history(spark, scratch).collect()]
    assert rows == [
        ("t1", "1", None, None, None, "[]"), ("t2", "2", None, None, None, "[]"),
        ("t3", "3", "a\nb", "{}", "o", "[1]"), ("t4", "4", None, None, None, None),
    ]


def test_null_and_empty_blank_lines_and_missing_files(spark, scratch):
    path = os.path.join(scratch, "x.csv")
    with open(path, "w") as f:
        f.write('timestamp,user_request,offer\n\nt1,,""\n\nt2," two ", three \n')
    rows = [(r.timestamp, r.user_request, r.offer) for r in csvlog.history(spark, path).collect()]
    assert rows == [("t1", None, ""), ("t2", " two ", " three ")]
    missing = csvlog.history(spark, os.path.join(scratch, "none.csv"))
    assert missing.count() == 0 and missing.columns == list(convlog.LOG_COLUMNS)


def test_open_quotes_raise(spark, scratch):
    path = os.path.join(scratch, "bad.csv")
    with open(path, "w") as f:
        f.write('timestamp,offer\nt1,"never closed\nt2,x\n')
    with pytest.raises(ValueError, match="balance"):
        csvlog.history(spark, path)


def test_exported_log_comes_back(spark, scratch):
    rows = [("t1", "1", " He said \"hi\",\nthen ", None, "", '["1", 2]'), ("t2", None, "\r\n", "{}", "a", "[]")]
    path = os.path.join(scratch, "csv")
    convlog.export_csv(spark.createDataFrame(rows, convlog.LOG_SCHEMA), path)
    assert [tuple(r) for r in csvlog.history(spark, path).collect()] == rows
