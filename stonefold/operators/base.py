"""SQL over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sql(text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL in which `{name}` stands for a DataFrame; no catalog entry is made."""
    return next(iter(frames.values())).sparkSession.sql(text, **frames)
