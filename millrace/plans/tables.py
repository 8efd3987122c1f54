"""Access to the given tables and the gaps that queries put into them by rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """One registered query and, where SQL can express it, the same result in SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events where every seventh value is missing."""
    events = table(spark, folder, "events")
    return events.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


GAPPY_EVENTS = """(SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""


def gappy_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Customers where every fifth segment and every third nation is missing."""
    customer = table(spark, folder, "customer")
    return customer.withColumns(
        {
            "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")),
            "c_nationkey": F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")),
        }
    )


GAPPY_CUSTOMER = """(SELECT c_custkey, c_name, c_acctbal,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})
