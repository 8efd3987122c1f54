"""Fitted steps on a stream.

Steps fitted on a batch table are projections and joins with a static table, so
the same ``transform`` accepts a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def apply_steps(df: DataFrame, steps: Sequence) -> DataFrame:
    for step in steps:
        df = step.transform(df)
    return df
