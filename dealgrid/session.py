"""SparkSession for local runs and tests.

Cluster jobs get their session from the platform; this helper only fills in
settings that are unset: AQE with partition coalescing and skew-join
splitting, UTC session time, Arrow for pandas conversions, no web UI, and
last-wins duplicate JSON keys.
``spark.checkpoint.dir`` is read from the session and only set (to a fresh
scratch folder) for a local session that has none.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from dealgrid.plans.sizing import checkpoint_dir

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a JSON object with a repeated key keeps the last value, as Python does
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dealgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DEALGRID_DRIVER_MEMORY", "8g"))
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
