"""The event log as a stream of JSON-line files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import LOG, zero_values
from ..operators import logs


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Entries of log files as they appear in a folder; malformed lines are skipped."""
    raw = spark.readStream.schema(LOG).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return zero_values(raw)


def usage_stream(entries: DataFrame) -> DataFrame:
    """The usage report over all entries so far, for output mode complete."""
    return logs.usage(entries)


def windowed_usage(entries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and cost by time window and provider; entries later than the watermark allows are left out."""
    timed = entries.filter("event = '' and timestamp is not null").withWatermark("timestamp", late)
    return timed.groupBy(F.window("timestamp", window), "provider").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def append_log(entries: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream of entries to a log folder as JSON lines, each batch in a folder by its number. A batch that is
    run again replaces its own folder, so what is read there holds every entry once, whoever reads it.

    once: take what there is and end."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").json(f"{folder}/batch={number}")

    return _started(entries, batch, checkpoint, once)


def refresh_stream(changed: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str, ledger: str, once: bool = False) -> StreamingQuery:
    """Call refresh with each batch of changed files (path, ...), once a path: the incremental graph build.

    ledger: a folder with an entry for each batch that is through. A batch with an entry is passed over when it comes
    again, as after the loss of a query between its work and its commit. Without an entry it is refreshed again, so
    refresh must replace what it wrote (as the build does, by path).
    """
    spark = changed.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def batch(rows: DataFrame, number: int) -> None:
        entry = path_of(f"{ledger}/batch={number}/_SUCCESS")
        if entry.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(entry):
            return
        once_each = rows.dropDuplicates(["path"])
        n = once_each.count()
        if n:
            refresh(once_each)
        spark.range(1).select(F.lit(n).alias("files")).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return _started(changed, batch, checkpoint, once)


def _started(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
