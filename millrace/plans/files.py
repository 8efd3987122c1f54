"""Registered queries: files and stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import clean, encode, impute, scale
from millrace.plans.tables import GAPPY_CUSTOMER, Query, gappy_categories, rounded, table
from millrace.session import shared_folder
from millrace.sources import delimited, stages


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV with gaps and read back with inferred types."""
    path = _new_folder(spark, "csv")
    delimited.save_csv(gappy_categories(spark, folder), path)
    return delimited.load_csv(spark, path)


def csv_single_letter_header(spark: SparkSession, folder: str) -> DataFrame:
    """Columns named by one letter keep their names and all their rows."""
    path = _new_folder(spark, "csv")
    delimited.save_csv(table(spark, folder, "customer").select(F.col("c_custkey").alias("x"), F.col("c_mktsegment").alias("y")), path)
    return delimited.load_csv(spark, path)


def csv_blank_first_line(spark: SparkSession, folder: str) -> DataFrame:
    """A file that begins with blank lines, and whose headers differ only in case."""
    path = _new_folder(spark, "csv")
    lines = table(spark, folder, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    head = spark.sql("SELECT explode(array('', '', 'key,KEY')) AS value")
    head.unionByName(lines).coalesce(1).write.text(path)
    return delimited.load_csv(spark, path)


def parquet_tightened(spark: SparkSession, folder: str) -> DataFrame:
    """Parts stored with all columns as text; columns that hold only numbers become numbers."""
    part = table(spark, folder, "part")
    path = _new_folder(spark, "parquet")
    delimited.save_parquet(part.select(*[F.col(c).cast("string").alias(c) for c in part.columns]), path)
    return delimited.load_parquet(spark, path, tighten=True)


def json_export(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate",
        F.when(F.col("o_orderkey") % 4 == 0, float("nan")).when(F.col("o_orderkey") % 4 == 1, float("inf"))
        .otherwise(F.col("o_orderkey") % 10 + 0.5).alias("ratio"),
    )
    return delimited.json_rows(orders)


def prepared_customers(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in a row: without duplicates, gaps filled, segments coded, balances standardised."""
    stages.put("df", gappy_categories(spark, folder).select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"))
    stages.put("df_cleaned", clean.convert(clean.drop_duplicates(stages.get(spark, "df")), "c_nationkey", "FLOAT"))
    stages.put("df_processed", impute.impute(stages.get(spark, "df_cleaned"), "c_nationkey", "median"))
    stages.put("df_encoded", encode.encode(stages.get(spark, "df_processed"), ["c_mktsegment"], "label"))
    stages.put("df_scaled", scale.scale(stages.get(spark, "df_encoded"), ["c_acctbal", "c_nationkey"], "standard"))
    return rounded(stages.get(spark, "df_scaled"), 6, "c_acctbal", "c_nationkey")


PREPARED_SQL = f"""WITH p AS (SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal,
    coalesce(c_nationkey::DOUBLE, (SELECT quantile_cont(c_nationkey::DOUBLE, 0.5) FROM {GAPPY_CUSTOMER})) AS k FROM {GAPPY_CUSTOMER})
  SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS c_mktsegment,
    round((k - (SELECT avg(k) FROM p)) / (SELECT stddev_pop(k) FROM p), 6) + 0.0 AS c_nationkey,
    round((c_acctbal - (SELECT avg(c_acctbal) FROM p)) / (SELECT stddev_pop(c_acctbal) FROM p), 6) + 0.0 AS c_acctbal FROM p"""


QUERIES = {
    "csv_round_trip": Query(
        csv_round_trip,
        f"SELECT c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal, c_mktsegment FROM {GAPPY_CUSTOMER}",
    ),
    "csv_single_letter_header": Query(csv_single_letter_header, "SELECT c_custkey AS x, c_mktsegment AS y FROM customer"),
    "csv_blank_first_line": Query(
        csv_blank_first_line, """SELECT n_nationkey::BIGINT AS key, n_name AS "KEY.1" FROM nation"""
    ),
    "parquet_tightened": Query(
        parquet_tightened,
        "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    ),
    "json_export": Query(
        json_export,
        """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":"' ||
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","ratio":' ||
        CASE WHEN o_orderkey % 4 < 2 THEN 'null' ELSE (o_orderkey % 10) || '.5' END || '}' AS json FROM orders""",
    ),
    "prepared_customers": Query(prepared_customers, PREPARED_SQL),
}
