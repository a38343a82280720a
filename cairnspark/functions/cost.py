"""Prices of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimate_cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """calls with estimated_usd. rates: (provider, model, input_usd, output_usd) per million tokens, one row a
    model: a small table by its meaning. Unknown models cost nothing."""
    priced = calls.join(rates.select("provider", "model", "input_usd", "output_usd"), ["provider", "model"], "left")
    usd = (F.coalesce("input_usd", F.lit(0.0)) * F.col("input_tokens") + F.coalesce("output_usd", F.lit(0.0)) * F.col("output_tokens")) / 1e6
    return priced.withColumn("estimated_usd", usd).drop("input_usd", "output_usd")
