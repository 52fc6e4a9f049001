"""JSON-lines ingest: skipped lines, key normalisation, last wins, defaults
(SURVEY S1-S6, F1, F5; FIXTURES §2)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from dealgrid.functions.ids import normalised_key
from dealgrid.operators.catalog import build_catalog, flatten_items
from dealgrid.sources import jsonl

LINES = [
    '{"merchant_id": 1, "name": "first", "lat": 1.5, "lon": 103.8, "rating": 4.0, "items": [{"name": "A", "price": 10}]}',
    "",
    "{broken",
    '{"merchant_id": "2", "name": "string key", "lat": null, "rating": "4.5", "items": [{"name": "B", "price": "10"}]}',
    '{"merchant_id": 3.9, "name": "float key", "items": []}',
    '{"merchant_id": null, "name": "no key"}',
    '{"name": "key absent"}',
    '{"merchant_id": "m-7", "name": "text key", "rating": null, "items": [{"name": "C", "price": -1}, {"name": "D", "price": 5, "discount_percent": 150}]}',
    '{"merchant_id": 1, "name": "last wins", "items": [{"name": "E", "price": 20, "discount_percent": 50}]}',
]


def _write(scratch, name, lines):
    path = os.path.join(scratch, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_merchant_file(spark, scratch):
    path = _write(scratch, "merchants.jsonl", LINES)
    m = jsonl.merchants(spark, path)
    rows = m.orderBy("pos").collect()
    assert [r.merchant_id for r in rows] == ["1", "2", "3", "m-7"]
    assert [r.name for r in rows] == ["last wins", "string key", "float key", "text key"]
    one, two, three, seven = rows
    assert (one.lat, one.lon, one.rating) == (1.29, 103.85, 0.0)
    assert two.lat is None and two.lon == 103.85 and two.rating == 4.5
    assert seven.rating is None
    assert (one.key_kind, seven.key_kind) == ("number", "text")

    cat = build_catalog(m, flatten_items(m)).select("merchant_id", "prices", "n_items")
    got = {r.merchant_id: (r.prices, r.n_items) for r in cat.collect()}
    assert got["1"] == ([10.0], 1)
    assert got["2"] == ([], 1)          # text price is not a valid price
    assert got["3"][1] == 0             # no items
    assert got["m-7"] == ([5.0], 2)     # negative price dropped, 150% counts as 0


def test_missing_file_gives_empty_table(spark, scratch):
    m = jsonl.merchants(spark, os.path.join(scratch, "absent.jsonl"))
    assert m.count() == 0 and "merchant_id" in m.columns


def test_key_normalisation(spark):
    rows = ['"12"', '" 12 "', '"12.5"', "true", "1.9", "-1.9", "1e3", '"1_0"', "null"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [
        (r.k.key_kind, r.k.key) if r.k else None
        for r in df.select(normalised_key(F.parse_json("j")).alias("k")).collect()
    ]
    assert got == [
        ("number", "12"), ("number", "12"), ("text", "12.5"), ("number", "1"),
        ("number", "1"), ("number", "-1"), ("number", "1000"), ("number", "10"), None,
    ]


def test_customers_file(spark):
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(here, "data", "customers.jsonl")
    c = jsonl.customers(spark, path).orderBy("pos").collect()
    assert [r.consumer_id for r in c] == ["71", "8"]
    assert c[1].postal_code == "009017"           # leading zero kept
    assert [(t.merchant_id, t.text_id) for t in c[0].transactions] == [("12", False), ("kiosk-4", True)]


def test_transactions_print_as_in_the_record(spark):
    from dealgrid.operators import render

    here = os.path.dirname(os.path.abspath(__file__))
    c = jsonl.customers(spark, os.path.join(here, "data", "customers.jsonl")).orderBy("pos")
    got = [r[0] for r in c.select(render.transactions_text(F.col("transactions"), written=True)).collect()]
    assert got == [str([(12, "Gifts", 3), ("kiosk-4", "Kids' corner", 12345678.5)]), "[]"]


def test_long_and_odd_ids_keep_apart(spark):
    from pyspark.sql import types as T

    from dealgrid.functions.ids import logged_key, plain_key

    raw = ["12345678901234567890", "12345678901234567891", "7.0", "7", "true", '"7"', "1.50", "-0.5", "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, j string").select(
        "i", F.parse_json("j").alias("v")
    )
    rows = df.select("i", logged_key(F.col("v")).alias("l"), normalised_key(F.col("v")).alias("n")).orderBy("i").collect()
    assert [tuple(r.l) if r.l else None for r in rows] == [
        ("number", raw[0]), ("number", raw[1]), ("number", "7"), ("number", "7"), ("number", "1"),
        ("text", "7"), ("number", "1.5"), ("number", "-0.5"), None]
    assert [r.n.key if r.n else None for r in rows] == [raw[0], raw[1], "7", "7", "1", "7", "1", "0", None]
    plain = {"double": (12.0, "12"), "boolean": (True, "1"), "string": ("abc", "abc"), "decimal(20,2)": (None, None)}
    for kind, (value, key) in plain.items():
        one = spark.createDataFrame([(value,)], f"c {kind}")
        got = one.select(plain_key(F.col("c"), one.schema["c"].dataType).alias("k")).first().k
        assert (got.key if got else None) == key, kind
    assert isinstance(one.schema["c"].dataType, T.DecimalType)


def test_repeated_json_key_keeps_its_record(spark, scratch):
    """In a session that forbids repeated keys by default, the record stays and the
    last value counts, as in Python."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    path = _write(scratch, "dup.jsonl", ['{"merchant_id": 1, "name": "a", "name": "b"}'])
    assert [(r.merchant_id, r.name) for r in jsonl.merchants(spark, path).collect()] == [("1", "b")]


def test_bad_request_id_does_not_fail_the_job(spark):
    from dealgrid.operators.requests import request_asks
    from dealgrid.plans import queries
    from dealgrid.sources import fixtures

    fx = fixtures.relations(spark, "/root/testdata/sf0.001")
    ids = F.when(F.col("request_id") % 2 == 0, F.lit("abc")).otherwise(F.col("request_id").cast("string"))
    req = queries.fixture_requests(fx).withColumn("customer_id", ids)
    found = {r.request_id % 2: r.status for r in request_asks(req, fx["fx_customers"]).collect() if r.status != "invalid_category"}
    assert found[0] == "customer_not_found" and found[1] == "ok"


def test_load_dimensions_and_request_ids(spark, scratch):
    from dealgrid.operators.intent import OK
    from dealgrid.operators.requests import request_asks

    m_path = _write(scratch, "m.jsonl", LINES)
    here = os.path.dirname(os.path.abspath(__file__))
    catalog, customers = jsonl.load_dimensions(spark, m_path, os.path.join(here, "data", "customers.jsonl"))
    assert catalog.count() == 4 and customers.count() == 2
    req = spark.createDataFrame(
        [(1, "71"), (2, " 8 "), (3, "x"), (4, "1_0")], "request_id long, customer_id string"
    ).select(
        "*",
        F.lit("food").alias("category"),
        F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi")).alias("budget"),
        F.lit(None).cast("double").alias("proximity_km"),
        F.lit(None).cast("double").alias("min_rating"),
        F.lit(None).cast("array<string>").alias("exact_items"),
        F.lit(None).cast("struct<recipient:string,cuisine:string,atmosphere:string,"
                         "participants:string,solo:boolean,type:string>").alias("specifics"),
        F.lit(False).alias("is_generic"), F.lit(False).alias("is_ambiguous"),
        F.lit("high").alias("confidence"),
        F.lit(None).cast("array<string>").alias("preferences"),
        F.lit(OK).alias("intent_status"),
    )
    st = {r.request_id: r.status for r in request_asks(req, customers).collect()}
    assert st == {1: "ok", 2: "ok", 3: "customer_not_found", 4: "customer_not_found"}


def test_last_wins_across_many_splits(spark, scratch):
    """One file read in many splits: order comes from (file, block, row id),
    so the last line still wins and the first position is kept."""
    lines = []
    for rep in range(3):
        for key in range(400):
            lines.append('{"merchant_id": %d, "name": "v%d", "pad": "%s"}' % (key, rep, "x" * 40))
    path = _write(scratch, "many.jsonl", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        recs = jsonl.read_records(spark, path)
        assert recs.rdd.getNumPartitions() > 10
        m = jsonl.merchants(spark, path)
        rows = m.orderBy("pos").select("merchant_id", "name").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.merchant_id for r in rows] == [str(k) for k in range(400)]
    assert {r.name for r in rows} == {"v2"}


def test_non_object_lines_are_skipped(spark, scratch):
    lines = ['5', '[1, 2]', '"text"', 'null', '{"merchant_id": 9, "name": "ok"} trailing',
             '{"merchant_id": 8, "name": "kept"}']
    m = jsonl.merchants(spark, _write(scratch, "odd.jsonl", lines))
    assert [(r.merchant_id, r.name) for r in m.collect()] == [("8", "kept")]


def test_glob_paths(spark, scratch):
    _write(scratch, "part-a.jsonl", ['{"merchant_id": 1, "name": "a"}'])
    _write(scratch, "part-b.jsonl", ['{"merchant_id": 2, "name": "b"}'])
    m = jsonl.merchants(spark, os.path.join(scratch, "part-*.jsonl"))
    assert sorted(r.merchant_id for r in m.collect()) == ["1", "2"]
