"""Named queries over the driver's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from . import graph, logs, notes, reports, stores, streams, text

    return {name: q for module in (logs, notes, graph, text, reports, stores, streams) for name, q in module.QUERIES.items()}
