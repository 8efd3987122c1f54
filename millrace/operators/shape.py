"""Small plan shapes used by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import quoted
from millrace.session import materialise

MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 20_000, 8 << 20
SALTS = 64


def records(aggregated: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn the one row of an aggregate into one row per record."""
    structs = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return aggregated.select(F.inline(F.array(*structs)))


def with_group_numbers(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-group numbers onto rows, adding ``cnt``, how many equal rows each row stands for.

    A table that ``bounded`` finds small is broadcast. For a larger one equal rows are first counted, the table is copied once per salt, and the
    join runs on key and salt, so the rows of one large group meet their numbers
    in many tasks.
    """
    table, small = bounded(table)
    if small:
        return rows.withColumn("cnt", F.lit(1)).join(F.broadcast(table), list(keys))
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("cnt"))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counted.withColumn("_salt", salt).join(salted, [*keys, "_salt"]).drop("_salt")


def bounded(table: DataFrame) -> tuple[DataFrame, bool]:
    """The table stored, and whether it is small enough to broadcast, in rows and in bytes."""
    kept = materialise(table)
    texts = [quoted(f.name) for f in table.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16 * len(table.columns)))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return kept, rows <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES


def few_tasks(stored: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """Merge the partitions of a stored table when it is too small to keep them all busy.

    Meant for iterative fits, which run many short jobs over the same rows.
    """
    partitions = stored.rdd.getNumPartitions()
    wanted = max(1, -(-stored.count() // rows_per_task))
    return stored.coalesce(wanted) if wanted < partitions else stored
