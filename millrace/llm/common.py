"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of the cluster and go on from the files.

    The files outlive lost executors and cut the lineage, and what was computed
    once stays as it was computed. ``schema`` reads the files as other types of the same form.
    """
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(schema or df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(remainder: int, modulus: int, key: str = "doc_id") -> Column:
    """True on rows whose crc32(key as text) leaves ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def text_digest(text: str) -> Column:
    """A digest of a whole text; null as empty."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose identifier and text are not in ``dropped`` (doc_id, digest): other rows of the same identifier stay."""
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("own"), text_digest(text).alias("said"))
    gone = dropped.select("doc_id", "digest").distinct()
    kept = marked.join(gone, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("said") == F.col("digest")), "left_anti")
    return kept.select("row.*")


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text; a longer text comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_binary())), 0), dtype=np.int64)
        part, start = 0, 0
        for i, n in enumerate(size.tolist()):
            if part and part + n > limit:
                yield batch.slice(start, i - start)
                part, start = 0, i
            part += n
        if start < batch.num_rows:
            yield batch.slice(start)
