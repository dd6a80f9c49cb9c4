"""What keeps plans small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where ``condition`` holds, decided on the columns as they are made.

    Spark pushes a plain filter below the projections that make its columns and so repeats their
    definitions for each use; over a chain of steps that use a column several times the plan grows
    exponentially. A row number is not deterministic, and nothing moves below it.
    """
    return df.withColumn("_held", F.monotonically_increasing_id()).where((F.col("_held") >= 0) & condition).drop("_held")
