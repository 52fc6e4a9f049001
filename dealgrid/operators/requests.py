"""Requests -> customers -> points -> match keys.

``request_asks`` takes requests carrying typed-intent columns and the
customer table, left-joins customers on the id (J1; both sides by the id rule of
``functions.ids``, so text, floating and boolean ids find their customer), resolves the district to
a point (J2, a literal-map lookup, no join) and builds the match key. A
request whose customer is unknown or whose intent is quarantined keeps its
row with ``status`` set and a NULL ``ask``: it gets no offers.

When the customer table is too large for the planner to broadcast, the join
isolates hot customers (``plans.skew.split_hot_join``): a customer holding a
large share of requests is joined through a broadcast of its own row, the
rest through a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.geo import district_point
from dealgrid.functions.ids import plain_key
from dealgrid.operators.intent import OK, ask_key
from dealgrid.plans.skew import planner_broadcasts, split_hot_join

CUSTOMER_NOT_FOUND = "customer_not_found"


def key_text(key: Column) -> Column:
    """Kind and key in one text, to join on; NULL without a key."""
    return F.concat(key["key_kind"], F.lit(":"), key["key"])


def request_asks(
    requests: DataFrame,
    customers: DataFrame,
    customer_key: str = "consumer_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``requests``: request_id, customer_id + typed-intent columns.
    ``customers``: ``customer_key`` + an ``address``-level ``district``.

    Returns ``request_id, customer_id, status, ask`` and the ``keep`` columns.
    """
    if "key_kind" in customers.columns:  # keyed by the JSON-lines loader
        cust_key = F.struct("key_kind", F.col(customer_key).alias("key"))
    else:
        cust_key = plain_key(F.col(customer_key), customers.schema[customer_key].dataType)
    cust = customers.select(
        key_text(cust_key).alias("_cust_key"),
        F.col("district").alias("_district"),
        F.lit(True).alias("_known"),
    )
    req_key = plain_key(F.col("customer_id"), requests.schema["customer_id"].dataType)
    keyed = requests.withColumn("_req_key", key_text(req_key))
    if planner_broadcasts(cust):
        joined = keyed.join(cust, F.col("_req_key") == F.col("_cust_key"), "left")
    else:
        # customers too large to broadcast: a customer holding many requests
        # must not put them all in one task
        joined = split_hot_join(keyed, cust, "_req_key", "_cust_key", ["request_id"], "left")
    status = (
        F.when(F.col("_known").isNull(), F.lit(CUSTOMER_NOT_FOUND))
        .when(F.col("intent_status") != OK, F.col("intent_status"))
        .otherwise(F.lit(OK))
    )
    return joined.select(
        "request_id",
        "customer_id",
        *keep,
        status.alias("status"),
        F.when(status == OK, ask_key(district_point(F.col("_district")))).alias("ask"),
    )
