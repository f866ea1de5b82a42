"""Window features of logs as a stream, from the same row measures as the batch features.

:func:`stream_features` keeps the open windows of one log in Spark's state store and drops late rows.
:func:`run_partials` keeps no state: each micro-batch stores the sums of its own rows, late windows
apart, so that one stream can join any number of logs and late rows can still be added.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from hostwin.functions.scalars import day_id
from hostwin.operators.datasets import add_up
from hostwin.operators.features import check_width, measured_rows, row_measures, sum_of
from hostwin.schemas import KEYS, WINDOW_SECONDS, log_schema


def read_log_stream(spark: SparkSession, kind: str, path: str,
                    files_per_batch: int | None = None) -> DataFrame:
    """A raw log as a stream of files, oldest first."""
    reader = spark.readStream.schema(log_schema(kind)).option("escape", '"')
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path)


def stream_features(rows: DataFrame, kind: str, width: int = WINDOW_SECONDS,
                    watermark: str = "1 hour") -> DataFrame:
    """Additive features per (src_comp, day, win) of a streaming log.

    Rows later than the watermark are dropped, and state older than it is released.
    """
    check_width(width)
    usable = measured_rows(rows, kind).na.drop(subset=["time", "src_comp"])
    timed = usable.withColumn("ts", F.timestamp_seconds("time"))
    measures = list(row_measures(kind))
    sums = timed.withWatermark("ts", watermark).groupBy(
        "src_comp", F.window("ts", f"{width} seconds").alias("w")).agg(
        *[sum_of(n) for n in measures])
    start = F.unix_seconds("w.start")
    return sums.select("src_comp", day_id(start).alias("day"), start.alias("win"), *measures)


class _Progress(StreamingQueryListener):
    """Adds up the progress of one query, however many batches it has."""

    def __init__(self) -> None:
        self.batches: dict[int, int] = {}
        self.query = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if str(progress.id) == self.query:
            self.batches[progress.batchId] = sum(
                op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == self.query:
            self.ended.set()


def run_stream(features: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Process everything available, then stop; returns batches and late rows dropped.

    Each micro-batch writes the windows it changed to a folder of its own number, so a
    repeated batch replaces itself. ``path`` and ``checkpoint`` must be shared folders.
    A source without a limit per batch gives its whole backlog as the first batch.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark, seen = features.sparkSession, _Progress()
    spark.streams.addListener(seen)
    try:
        query = (features.writeStream.outputMode("update").foreachBatch(store)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        seen.query = str(query.id)
        # The last progress also stays with the query; earlier ones reach the listener in order.
        query.awaitTermination()
        seen.ended.wait(60)
        for progress in query.recentProgress:
            seen.batches[progress["batchId"]] = sum(
                op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
    finally:
        spark.streams.removeListener(seen)
    return {"batches": len(seen.batches), "late_rows": sum(seen.batches.values())}


def run_partials(rows: DataFrame, path: str, checkpoint: str, width: int = WINDOW_SECONDS,
                 delay: int = 3600) -> int:
    """Process everything available of streaming rows, then stop; returns the batches stored.

    ``rows`` are those of :func:`hostwin.operators.features.keyed_rows` or, for all logs and their labels,
    :func:`hostwin.operators.datasets.master_rows`. Each micro-batch adds up its own rows and writes the sums
    to a folder of its own number, so a repeated batch replaces itself and nothing but the newest window
    start is carried on. A window that ended over ``delay`` seconds before the newest start of earlier
    batches is late: its sums are stored apart. Rows without host or time are left out; a window in several batches has
    a row in each, which :func:`read_partials` adds up. ``path`` and ``checkpoint`` must be shared folders.
    """
    check_width(width)
    spark, done = rows.sparkSession, []

    def store(batch: DataFrame, number: int) -> None:
        newest = _newest(spark, path, number - 1)
        sums = add_up(batch.na.drop(subset=KEYS))
        late = F.lit(False) if newest is None else F.col("win") + width <= newest - delay
        folder = f"{path}/sums/batch={number}"
        sums.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(folder)
        own = spark.read.schema(sums.schema).parquet(folder).agg(F.max("win").alias("win")).first().win
        newest = max((w for w in (newest, own) if w is not None), default=None)
        spark.range(1).select(F.lit(newest).cast("bigint").alias("win")).write.mode("overwrite").parquet(
            f"{path}/newest/{number}")
        done.append(number)

    (rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return len(done)


def _newest(spark: SparkSession, path: str, number: int) -> int | None:
    """The newest window start of the batches up to a number; the first batch has none before it."""
    if number < 0:
        return None
    return spark.read.schema("win bigint").parquet(f"{path}/newest/{number}").first().win


def read_partials(spark: SparkSession, path: str, late: bool | None = None) -> DataFrame:
    """The windows stored by :func:`run_partials`: all rows, or only those in time or late.

    Sums over both are what a batch run over all rows gives.
    """
    rows = spark.read.parquet(f"{path}/sums")
    if late is not None:
        rows = rows.filter(F.col("late") == late)
    return add_up(rows.drop("batch", "late"))


def compact_windows(spark: SparkSession, path: str, target: str, files_per_day: int = 16) -> None:
    """Write the last state of every window once, one folder per day.

    Readers of many batches then read each window once; batches stored so far can be removed.
    Hosts are dealt over ``files_per_day`` files, so a day is not the work of one task.
    """
    _write_days(read_windows(spark, path), target, files_per_day)


def compact_partials(spark: SparkSession, path: str, target: str, late: bool | None = None,
                     files_per_day: int = 16) -> None:
    """Write the windows of :func:`read_partials` once, as :func:`compact_windows` does."""
    _write_days(read_partials(spark, path, late), target, files_per_day)


def _write_days(rows: DataFrame, target: str, files_per_day: int) -> None:
    part = F.pmod(F.xxhash64("src_comp"), F.lit(files_per_day))
    rows.repartition(F.col("day"), part).write.mode("overwrite").partitionBy("day").parquet(target)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every window a stream has written."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*KEYS, "batch")]
    last = F.max_by(F.struct(*values), F.col("batch")).alias("v")
    return rows.groupBy(*KEYS).agg(last).select(*KEYS, "v.*")
