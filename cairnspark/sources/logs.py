"""The event log: JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..model import LOG, zero_values


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log, absent fields as zero values; malformed lines are skipped; a missing file is an
    empty log. ord: a row's place in its file, from its block's offset and its line in the block."""
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        lines.schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG).withColumn("ord", F.lit(0).cast("bigint")).filter("false")
    parsed = lines.withColumn("e", F.from_json("value", LOG, {"mode": "PERMISSIVE"})).withColumn("raw", F.try_parse_json("value"))
    entries = parsed.filter("raw is not null and trim(value) like '{%'").select("e.*", F.col("line").alias("ord"))
    return zero_values(entries)


def last_rows(log: DataFrame, n: int) -> DataFrame:
    """The last n rows in file order."""
    return log.orderBy(F.desc("ord")).limit(n).orderBy("ord")
