"""Numbers along an order, without a task that has all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

#: monotonically_increasing_id counts the rows of a partition in so many low bits.
ROW_BITS = 33


def placed(rows: DataFrame, order: list, name: str = "placed") -> DataFrame:
    """rows in the order, written, with places (at): numbers that rise along it. The order is a range partitioning."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Placed rows, whose order begins with the keys, with their numbers (n) from 0 within a key: places, less the
    first place of the key in the partition, plus its rows in earlier partitions."""
    part = F.shiftright("at", ROW_BITS).alias("part")
    parts = rows.groupBy(*keys, part).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select(*keys, "part", (before - F.col("first")).alias("shift"))
    return rows.withColumn("part", part).join(shift, [*keys, "part"]).withColumn("n", F.col("at") + F.col("shift")).drop("part", "shift")
