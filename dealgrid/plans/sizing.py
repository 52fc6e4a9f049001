"""Materialisation and size-checked broadcast.

* ``checkpoint_dir(spark)`` reads ``spark.checkpoint.dir`` from the session
  (the cluster names a shared folder there). Only a local-mode session with
  no setting gets a fresh scratch folder, as in tests.
* ``materialize(df)`` writes a reused intermediate as a Parquet table in that
  shared folder and reads it back: one job, lineage cut, and the data
  survives the loss of executors (``checkpoint()`` would compute the plan
  twice: once for the action, once for the checkpoint write).
* ``measured_broadcast(df)`` materialises a dictionary, measures its rows with their
  payload and hints ``broadcast`` only when they fit the limit; otherwise the plain
  DataFrame goes back and the join is a shuffle join (``plans.skew`` salts it).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT_CONF = "dealgrid.broadcast.maxBytes"
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/...) reachable by every executor"
            )
        configured = tempfile.mkdtemp(prefix="dealgrid-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder for this application's intermediate data:
    ``<spark.checkpoint.dir>/dealgrid/<application id>/<kind>/<uuid>``."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark).rstrip('/')}/dealgrid/{app}/{kind}/{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> bool:
    """Delete everything this application wrote under the checkpoint folder
    (materialised tables, scratch JSON lines, stream state). Call it once the
    results are written: DataFrames built before still read those tables."""
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark).rstrip('/')}/dealgrid/{app}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return bool(fs.exists(jpath) and fs.delete(jpath, True))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder."""
    spark = df.sparkSession
    path = work_dir(spark, f"tables/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_count(text: str) -> int:
    """A size as Spark settings write it: ``-1``, ``10485760b``, ``256k``, ``10MB``."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def broadcast_limit(spark: SparkSession) -> int:
    return byte_count(str(spark.conf.get(BROADCAST_LIMIT_CONF, str(DEFAULT_BROADCAST_LIMIT))))


def _value_bytes(name: str, kind: T.DataType) -> Column:
    """Upper estimate of a value's bytes in a hashed relation."""
    col = F.col(name)
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(col) + 24
    elif isinstance(kind, T.ArrayType) and isinstance(
        kind.elementType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType
    ):
        size = F.size(col) * 8 + 32
    elif isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        size = F.octet_length(F.to_json(F.struct(col))) * 4 + 64
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(8)).cast("long")


ROW_OVERHEAD = 64


def relation_bytes(df: DataFrame) -> int:
    """Bytes that ``df``, whole rows with their payload, takes as a broadcast
    relation: one aggregation over its values."""
    row = F.lit(ROW_OVERHEAD).cast("long")
    for f in df.schema:
        row = row + _value_bytes(f"`{f.name}`", f.dataType)
    return int(df.agg(F.sum(row).alias("n")).first()["n"] or 0)


def measured_broadcast(df: DataFrame, name: str = "relation") -> DataFrame:
    """``df`` written once, and hinted for broadcast only if its measured rows fit
    the limit; else as it is, for a shuffle join."""
    m = materialize(df, name)
    return F.broadcast(m) if relation_bytes(m) <= broadcast_limit(df.sparkSession) else m
