"""Exposure counts as a Structured Streaming job.

The log grows by appends; the leaderboard counts are all-time. A file-source
stream over the log's Parquet folder decodes and explodes each new file and
keeps a running count per id (state = one row per distinct id, no watermark
because nothing expires). ``foreachBatch`` writes each micro-batch's complete
result to a folder of its own, ``batch=<id>``; a batch counts as published when its
last table's ``_SUCCESS`` file is there, which the committer writes last.
``published`` reads the newest such batch, so a reader sees the previous batch until
the next is whole, also after a crash; a batch that was published is not written
again when the stream repeats it. Older batches than ``KEPT`` are removed.

The checkpoint location lives under the session's shared checkpoint folder, so a
restarted job resumes where it stopped and files are counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.operators.exposure import exposure_counts, leaderboard
from dealgrid.plans.sizing import work_dir

COUNTS, BOARD = "counts", "leaderboard"
#: Batches that stay readable behind the newest.
KEPT = 5


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath  # noqa: SLF001


def _is_published(spark: SparkSession, out_path: str, batch: int, table: str) -> bool:
    fs, done = _fs(spark, f"{out_path}/batch={batch}/{table}/_SUCCESS")
    return bool(fs.exists(done))


def _batches(spark: SparkSession, out_path: str) -> list[int]:
    fs, root = _fs(spark, out_path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def published(spark: SparkSession, out_path: str, table: str = COUNTS, last: str = COUNTS) -> DataFrame | None:
    """The newest whole batch of ``table``; None before the first. ``last``: the
    table that the stream writes last (``BOARD`` if it writes one)."""
    for batch in reversed(_batches(spark, out_path)):
        if _is_published(spark, out_path, batch, last):
            return spark.read.parquet(f"{out_path}/batch={batch}/{table}")
    return None


def start_exposure_stream(
    spark: SparkSession,
    log_path: str,
    out_path: str,
    checkpoint: str,
    available_now: bool = True,
    merchants: DataFrame | None = None,
    files_per_batch: int | None = None,
):
    """Start the stream; returns the ``StreamingQuery``. With ``merchants`` each
    batch also publishes the leaderboard (J4, W3): the batch's counts joined to the
    static merchant table."""
    schema = spark.read.parquet(log_path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    counts = exposure_counts(reader.parquet(log_path))
    last = COUNTS if merchants is None else BOARD

    def publish(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        if _is_published(session, out_path, epoch, last):
            return
        folder = f"{out_path}/batch={epoch}"
        batch.write.mode("overwrite").parquet(f"{folder}/{COUNTS}")
        if merchants is not None:
            written = session.read.parquet(f"{folder}/{COUNTS}")
            leaderboard(written, merchants).write.mode("overwrite").parquet(f"{folder}/{BOARD}")
        for old in _batches(session, out_path):
            if old < epoch - KEPT:
                fs, path = _fs(session, f"{out_path}/batch={old}")
                fs.delete(path, True)

    writer = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def run_exposure_stream(
    spark: SparkSession,
    log: DataFrame,
    batches: int = 4,
    merchants: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Feed ``log`` into a fresh log folder, run the stream over it in about
    ``batches`` micro-batches until caught up, and return the published counts and
    leaderboard. The log is written once, by all tasks; rows are dealt to files by a
    random number, so equal rows spread too."""
    base = work_dir(spark, "stream")
    log_path, out_path, ckpt = f"{base}/log", f"{base}/counts", f"{base}/_checkpoint"
    log.select("recommended_merchants").withColumn(
        "part", F.floor(F.rand(7) * batches).cast("int")
    ).write.partitionBy("part").parquet(log_path)
    fs, root = _fs(spark, log_path)
    files = fs.getContentSummary(root).getFileCount()
    query = start_exposure_stream(
        spark, log_path, out_path, ckpt,
        merchants=merchants, files_per_batch=max(1, files // batches),
    )
    query.awaitTermination()
    counts = published(spark, out_path)
    board = published(spark, out_path, BOARD, BOARD) if merchants is not None else None
    return counts, board
