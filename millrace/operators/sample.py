"""Random samples of an exact size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def uniform(key: Sequence[str] | None, seed: int) -> Column:
    """A number in [0, 1) per row, from an md5 of ``key`` (which any SQL has) or, without one, from ``rand``."""
    if not key:
        return F.rand(seed)
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / float(2**52)


def share_for(n: int, total: int) -> float:
    """A share of rows that holds n of them for all but one in 10^20 draws."""
    return min(1.0, (n + 10 * math.sqrt(n) + 10) / max(1, total))


def sample_rows(df: DataFrame, n: int, seed: int = SEED, key: Sequence[str] | None = None) -> DataFrame:
    """Exactly n random rows, or the whole table when it has no more.

    Only slightly more rows than wanted reach the final sort. ``key`` names
    columns that identify a row and makes the choice independent of the
    partitioning.
    """
    total = df.count()
    if total <= n:
        return df
    drawn = df.withColumn("_u", uniform(key, seed))
    few = drawn.where(F.col("_u") < share_for(n, total))
    if key and few.limit(n).count() < n:
        few = drawn  # equal keys draw equal numbers, which can leave too few rows
    return few.orderBy("_u").limit(n).drop("_u")
