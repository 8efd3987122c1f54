"""Named stages of one preparation run, stored and kept as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import materialise

ORDER = ["df", "df_cleaned", "df_processed", "df_encoded", "df_scaled"]


def put(name: str, df: DataFrame, keep: bool = True) -> DataFrame:
    """Name a stage. It is stored in the shared folder, so later stages do not compute it again, unless ``keep`` is off."""
    df = materialise(df) if keep else df
    df.createOrReplaceTempView(name)
    return df


def get(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise KeyError(f"no table loaded as '{name}'")
    return spark.table(name)


def names(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables() if t.isTemporary]
