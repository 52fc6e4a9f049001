"""Relations derived from the driver tables (see FIXTURES.md §3).

The driver ships TPC-H-like tables; the offer matcher needs merchants, items,
customers, intents, requests, a conversation log and model responses. Each
relation below is one SQL body that runs unchanged in Spark SQL and in DuckDB,
so the Spark queries and the DuckDB oracle start from identical inputs:

* ``relations(spark, sf_dir)`` returns the parquet tables and the ``fx_*``
  relations on top of them as DataFrames (no session-wide views);
* ``oracle_prelude(names)`` returns the same bodies as a DuckDB ``WITH`` list.

The flat ``fx_items`` view is nested into per-merchant catalog columns by
``dealgrid.operators.catalog``; the oracle keeps it flat.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from dealgrid.functions.geo import GAZETTEER

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def _gazetteer_values() -> str:
    rows = ",".join(
        f"('{name}',{lat!r}e0,{lon!r}e0)" for name, (lat, lon) in GAZETTEER.items()
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(district, lat, lon)"


# name -> SQL body, in dependency order.
VIEWS: dict[str, str] = {
    "fx_gazetteer": _gazetteer_values(),
    "fx_merchants": """
SELECT s.s_suppkey AS merchant_id, s.s_suppkey AS pos, s.s_name AS name,
 p.v AS primary_category, c.v AS category,
 CASE WHEN s.s_suppkey % 19 = 3 THEN NULL
      ELSE 3e0 + (s.s_suppkey % 21) / 1e1 END AS rating,
 CASE WHEN s.s_suppkey % 23 = 7 THEN NULL WHEN s.s_suppkey % 23 = 11 THEN 1.29e0
      ELSE 1.24e0 + ((s.s_suppkey * 37) % 200) / 1e3 END AS lat,
 CASE WHEN s.s_suppkey % 23 = 7 THEN NULL WHEN s.s_suppkey % 23 = 11 THEN 103.85e0
      ELSE 103.65e0 + ((s.s_suppkey * 53) % 360) / 1e3 END AS lon,
 n.n_name AS district
FROM supplier s
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN (VALUES (0,'Food'),(1,'Travel'),(2,'Activities'),(3,'Gifts'),(4,'Retail')) AS p(i, v)
  ON s.s_suppkey % 5 = p.i
JOIN (VALUES (0,'Japanese fine dining'),(1,'Hawker Chinese'),(2,'Spa and wellness'),
 (3,'Theme park'),(4,'Gym and fitness'),(5,'Florist gifts'),(6,'Food court kids'),
 (7,'Wildlife travel tours'),(8,'Solo activities workshop'),(9,NULL),
 (10,'Jewelry and fashion')) AS c(i, v)
  ON s.s_suppkey % 11 = c.i""",
    "fx_items": """
SELECT l.l_suppkey AS merchant_id, l.l_partkey AS pos, p.p_name AS name,
 CASE WHEN l.l_partkey % 37 = 0 THEN -1e0 WHEN l.l_partkey % 41 = 0 THEN NULL
      ELSE ((l.l_partkey * 7) % 400) + 5e-1 END AS price,
 CASE WHEN l.l_partkey % 43 = 0 THEN 150e0
      ELSE min(l.l_discount) * 1e2 END AS discount_percent
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY l.l_suppkey, l.l_partkey, p.p_name""",
    "fx_customers": """
SELECT c.c_custkey AS consumer_id, c.c_name AS name, c.c_mktsegment AS occupation,
 21 + c.c_custkey % 50 AS age,
 CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
 c.c_acctbal AS balance, d.v AS district
FROM customer c
JOIN (VALUES (0,'Orchard'),(1,'Tanjong Pagar'),(2,'MARINA BAY'),(3,'Jurong'),
 (4,'Holland'),(5,'City Hall'),(6,'Clarke Quay'),(7,'Changi'),(8,'Dempsey'),
 (9,'Tampines'),(10,'Sentosa'),(11,'bugis'),(12,'Geylang'),(13,'Raffles Place'),
 (14,'Kallang'),(15,'Katong'),(16,'Little India'),(17,'Kampong Glam'),
 (18,'Harbourfront'),(19,'Tanglin'),(20,'Mandai'),(21,'Nowhere'),(22,NULL)) AS d(i, v)
  ON c.c_custkey % 23 = d.i""",
    "fx_transactions": """
SELECT o.o_custkey AS consumer_id,
 row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS pos,
 o.o_orderkey % 100 AS merchant_id, o.o_totalprice AS amount,
 o.o_orderpriority AS category FROM orders o""",
    "fx_intents": """
SELECT intent_id, category, price_range, CAST(proximity_km AS DOUBLE) AS proximity_km,
 CAST(min_rating AS DOUBLE) AS min_rating, exact_items, cuisine, atmosphere,
 participants, solo, activity_type, recipient, is_generic, is_ambiguous,
 confidence, preferences
FROM (VALUES
 (0,'food',NULL,30,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (1,'food','under $50',NULL,4,NULL,'japanese',NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (2,'food','around 50',12,NULL,NULL,'chinese','fine dining',NULL,false,NULL,NULL,false,false,'high',NULL),
 (3,'food','cheap',NULL,NULL,'widget',NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (4,'Food','mid-range',20,NULL,NULL,'thai','quiet',NULL,false,NULL,NULL,false,false,'high',NULL),
 (5,'food','SGD 30',NULL,3.5,NULL,NULL,NULL,NULL,false,NULL,NULL,true,false,'high','japanese|hawker'),
 (6,'food','$10-$90',30,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,true,'medium','Japanese'),
 (7,'activities',NULL,10,NULL,NULL,NULL,NULL,'family',false,NULL,NULL,false,false,'high',NULL),
 (8,'activities','expensive',NULL,NULL,NULL,NULL,NULL,'couple',false,NULL,NULL,false,false,'high',NULL),
 (9,'activities','about 100 sgd',25,NULL,NULL,NULL,NULL,NULL,false,'sports',NULL,false,false,'high',NULL),
 (10,'activities','$200',NULL,NULL,NULL,NULL,NULL,NULL,true,NULL,NULL,false,false,'high',NULL),
 (11,'activities','$10-',40,4.5,NULL,NULL,NULL,'Family',true,'Sports',NULL,true,false,'low','wildlife'),
 (12,'gifts',NULL,NULL,NULL,NULL,NULL,NULL,NULL,false,NULL,'Mother',false,false,'high',NULL),
 (13,'gifts','10-50',15,NULL,NULL,NULL,NULL,NULL,false,NULL,'mother',false,false,'high',NULL),
 (14,'gifts','under $50 each',NULL,NULL,'ring|hot',NULL,NULL,NULL,false,NULL,'father',false,false,'high',NULL),
 (15,'travel','$50-$20',NULL,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (16,'travel','-20',20,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (17,'travel','120.5',NULL,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'low','tours'),
 (18,'general',NULL,NULL,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,true,false,'low',NULL),
 (19,'general',NULL,5,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (20,'general','$1,000',NULL,NULL,'gear',NULL,NULL,NULL,false,NULL,NULL,true,false,'low','spa'),
 (21,'general','around $50',NULL,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,true,'high','spa|theme park'),
 (22,'General','under 50',10,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (23,'','0',NULL,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (24,'travel','',0,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (25,NULL,'cheap',10,NULL,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,'high',NULL),
 (26,'food','around 1,000',NULL,0,NULL,NULL,NULL,NULL,false,NULL,NULL,false,false,NULL,NULL)
) AS t(intent_id, category, price_range, proximity_km, min_rating, exact_items,
 cuisine, atmosphere, participants, solo, activity_type, recipient, is_generic,
 is_ambiguous, confidence, preferences)""",
    "fx_requests": """
SELECT c.c_custkey AS request_id,
 CASE WHEN c.c_custkey % 101 = 100 THEN c.c_custkey + 1000000000
      ELSE c.c_custkey END AS customer_id,
 CAST(c.c_custkey % 27 AS INT) AS intent_id
FROM customer c""",
    "fx_log": """
SELECT event_id AS log_id, ts, user_id AS customer_id,
 CASE event_id % 11
  WHEN 0 THEN '[]' WHEN 1 THEN 'bad' WHEN 2 THEN NULL
  WHEN 3 THEN '["' || k || '"]' WHEN 4 THEN k
  WHEN 5 THEN '[' || k || ', null, ' || k || ']'
  WHEN 6 THEN '{broken' WHEN 7 THEN 'null'
  ELSE '[' || k || ', ' || CAST((CAST(k AS INT) * 3 + 1) % 120 AS VARCHAR(9)) || ']'
 END AS recommended_merchants
FROM (SELECT event_id, ts, user_id,
 replace(replace(props, '{"k": ', ''), '}', '') AS k FROM events) e""",
    "fx_intent_json": """
SELECT r.request_id,
 '{"category": ' || CASE WHEN r.request_id % 41 = 7 THEN 'null' WHEN r.request_id % 43 = 7 THEN '5'
   ELSE '"' || coalesce(i.category, '') || '"' END
 || ', "price_range": ' || CASE WHEN r.request_id % 37 = 3 THEN '[1, 2]'
   WHEN r.request_id % 4 = 0 THEN '{"min": ' || CAST(r.request_id % 50 AS VARCHAR(9))
     || ', "max": "' || CAST(60 + r.request_id % 300 AS VARCHAR(9)) || '"}'
   WHEN r.request_id % 4 = 1 THEN 'null' WHEN i.price_range IS NULL THEN '""'
   ELSE '"' || i.price_range || '"' END
 || CASE r.request_id % 3 WHEN 0 THEN ', "proximity_km": ' || CAST(5 + r.request_id % 40 AS VARCHAR(9))
   WHEN 1 THEN ', "proximity_km": "near"' ELSE '' END
 || CASE r.request_id % 5 WHEN 0 THEN ', "min_rating": "3.5"' WHEN 1 THEN ', "min_rating": 4' ELSE '' END
 || CASE WHEN r.request_id % 31 = 5 THEN ', "exact_items": 3' WHEN i.exact_items IS NULL THEN ''
   ELSE ', "exact_items": ["' || replace(i.exact_items, '|', '", "') || '"]' END
 || CASE WHEN r.request_id % 29 = 4 THEN ', "specifics": null' ELSE
   ', "specifics": {"solo": ' || CASE WHEN i.solo THEN 'true' ELSE 'false' END
   || coalesce(', "recipient": "' || i.recipient || '"', '')
   || coalesce(', "cuisine": "' || i.cuisine || '"', ', "cuisine": null')
   || coalesce(', "atmosphere": "' || i.atmosphere || '"', '')
   || coalesce(', "participants": "' || i.participants || '"', '')
   || coalesce(', "type": "' || i.activity_type || '"', '') || '}' END
 || ', "is_generic": ' || CASE WHEN i.is_generic THEN 'true' ELSE '0' END
 || ', "is_ambiguous": ' || CASE WHEN i.is_ambiguous THEN '1' ELSE 'false' END
 || CASE WHEN i.confidence IS NULL THEN '' ELSE ', "confidence": "' || i.confidence || '"' END || '}' AS j
FROM fx_requests r JOIN fx_intents i ON r.intent_id = i.intent_id""",
    "fx_responses": """
SELECT request_id, step,
 CASE WHEN step = 3 THEN CASE request_id % 5 WHEN 0 THEN '["spa", "japanese", "spa"]'
   WHEN 1 THEN ' ["theme park", 7]' WHEN 2 THEN '{"no": "list"}' WHEN 3 THEN 'prose' ELSE '' END
 ELSE CASE (request_id + step) % 6 WHEN 0 THEN j WHEN 1 THEN 'Sure: ' || j || ' done'
   WHEN 2 THEN 'no object' WHEN 3 THEN '' WHEN 4 THEN CASE WHEN request_id % 47 = 9 THEN '[1]' ELSE '{}' END
   ELSE NULL END END AS content
FROM (SELECT q.request_id, q.j, s.step
 FROM fx_intent_json q CROSS JOIN (VALUES (1), (2), (3)) AS s(step)) t""",
    # what the last call, for the offer text, returned: text or an error
    "fx_offer_responses": """
SELECT request_id,
 CASE request_id % 5 WHEN 0 THEN '  Two offers for request ' || CAST(request_id AS VARCHAR(20)) || chr(10)
  WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN chr(10) || chr(9) || ' '
  ELSE 'Offer: "half price", today' END AS content,
 CASE WHEN request_id % 5 = 2 AND request_id % 2 = 0 THEN 'timeout after 30 s' END AS error
FROM fx_requests""",
    # merchant records as written: fields absent, null, text or number
    "fx_merchant_json": """
SELECT merchant_id, '{"merchant_id": ' || CASE WHEN merchant_id % 4 = 0
   THEN '"' || CAST(merchant_id AS VARCHAR(20)) || '"' ELSE CAST(merchant_id AS VARCHAR(20)) END
 || CASE merchant_id % 5 WHEN 0 THEN '' WHEN 1 THEN ', "name": null' ELSE ', "name": "' || name || '"' END
 || CASE merchant_id % 3 WHEN 0 THEN '' ELSE ', "primary_category": "' || primary_category || '"' END
 || CASE merchant_id % 6 WHEN 0 THEN '' WHEN 1 THEN ', "rating": null' WHEN 2 THEN ', "rating": "4.0"'
   WHEN 3 THEN ', "rating": 4' ELSE ', "rating": 4.25' END
 || CASE merchant_id % 7 WHEN 0 THEN '' WHEN 1 THEN ', "address": {}' WHEN 2 THEN ', "address": {"district": null}'
   ELSE ', "address": {"district": "' || district || '"}' END
 || ', "items": [{"name": "first"' || CASE merchant_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', "price": null'
   WHEN 2 THEN ', "price": "12.5"' ELSE ', "price": 20' END || '}, {"price": 8'
 || CASE merchant_id % 5 WHEN 0 THEN '' WHEN 1 THEN ', "discount_percent": null'
   WHEN 2 THEN ', "discount_percent": "half"' WHEN 3 THEN ', "discount_percent": "25"'
   ELSE ', "discount_percent": 150' END || '}, {"name": "third", "price": "free"}, {"name": "fourth", "price": 1}]}' AS value
FROM fx_merchants""",
    # logged ids in every written form
    "fx_id_log": """
SELECT event_id AS log_id, CASE event_id % 6
  WHEN 0 THEN '[1234567890123456789' || CAST(event_id % 3 AS VARCHAR(9)) || ']'
  WHEN 1 THEN '["7"]' WHEN 2 THEN '[7.0, 7]' WHEN 3 THEN '[true, 1]' WHEN 4 THEN '[1.50]'
  ELSE '[1e1, 10]' END AS recommended_merchants
FROM events""",
}

# Spark-side text where it differs from the shared one: the response steps
# come from an explode of an array instead of a join with a small table (same rows,
# no cartesian product in the Spark plan).
SPARK_VIEWS: dict[str, str] = {
    "fx_responses": """
SELECT request_id, step,
 CASE WHEN step = 3 THEN CASE request_id % 5 WHEN 0 THEN '["spa", "japanese", "spa"]'
   WHEN 1 THEN ' ["theme park", 7]' WHEN 2 THEN '{"no": "list"}' WHEN 3 THEN 'prose' ELSE '' END
 ELSE CASE (request_id + step) % 6 WHEN 0 THEN j WHEN 1 THEN 'Sure: ' || j || ' done'
   WHEN 2 THEN 'no object' WHEN 3 THEN '' WHEN 4 THEN CASE WHEN request_id % 47 = 9 THEN '[1]' ELSE '{}' END
   ELSE NULL END END AS content
FROM (SELECT q.request_id, q.j, s.step
 FROM fx_intent_json q LATERAL VIEW explode(array(1, 2, 3)) s AS step) t""",
}

# Which fx views each view reads (to emit only the needed CTEs).
_DEPS: dict[str, tuple[str, ...]] = {
    "fx_intent_json": ("fx_requests", "fx_intents"),
    "fx_responses": ("fx_intent_json",),
    "fx_offer_responses": ("fx_requests",),
    "fx_merchant_json": ("fx_merchants",),
}


# Driver tables the fx views read.
USED_TABLES = ("customer", "supplier", "nation", "part", "orders", "lineitem", "events")


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver tables of ``sf_dir`` the fixtures read and every ``fx_*``
    relation, as DataFrames.

    Each SQL body runs through ``spark.sql`` with the relations it reads passed
    as DataFrame arguments, so nothing is registered in the session catalog:
    a caller's own views are untouched and several folders can be used side
    by side.
    """
    rel: dict[str, DataFrame] = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in USED_TABLES
    }
    for name, body in VIEWS.items():
        text = SPARK_VIEWS.get(name, body).replace("{", "{{").replace("}", "}}")
        args = {}
        for ref in rel:
            pattern = rf"(?<![\w.]){ref}(?![\w])"
            if re.search(pattern, text):
                text = re.sub(pattern, "{" + ref + "}", text)
                args[ref] = rel[ref]
        rel[name] = spark.sql(text, **args)
    return rel


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register the relations as temp views (for interactive use)."""
    for name, df in relations(spark, sf_dir).items():
        df.createOrReplaceTempView(name)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return relations(spark, sf_dir)[name]


def oracle_prelude(*names: str) -> str:
    """``WITH`` clause defining the requested fx views (and their inputs)."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for dep in _DEPS.get(n, ()):
            add(dep)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n)
    ordered = [n for n in VIEWS if n in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered) + "\n"
