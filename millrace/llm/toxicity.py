"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every n-gram of a document's words counts once per document, hashed to a bucket.
Over the training documents Spark counts in how many toxic and other ones a bucket occurs. A bucket's feature value is its
log-count ratio; every bucket whose two rates differ clearly gets one. The weights on these values are a logistic
regression. Both are fitted on at most about ``FIT_ROWS`` labelled documents, drawn by a hash of
their identifier, so that only their texts have to meet their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import held_out, slices, stored
from millrace.llm.letters import letter_codes

SIZES = (4, 5, 6)
BUCKETS = 1 << 20
#: Labelled documents that the classifier is fitted on by default. A bound, in expectation.
FIT_ROWS = 20_000
#: Pseudo count of the ratios; documents a bucket needs; standard errors by which its rates must differ.
SMOOTH, LEAST, CLEAR = 1.0, 5, 4.0
RIDGE, STEPS = 1e-4, 300


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams within words and their ends, and the text each is from; n-grams by length."""
    codes, text = letter_codes(texts)
    codes = codes.astype(np.uint64)
    # Steps to the next word end: an n-gram may begin or end with one, but not have one inside.
    zero = np.nonzero(codes == 0)[0]
    next_zero = zero[np.searchsorted(zero, np.arange(1, len(codes) + 1), "left").clip(max=len(zero) - 1)]
    room = next_zero - np.arange(len(codes)) + 1
    found, owner = [], []
    for n in SIZES:
        at = np.nonzero(room >= n)[0]
        at = at[at + n <= len(codes)]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        found.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        owner.append(text[at + 1].astype(np.int64))
    return np.concatenate(found), np.concatenate(owner)


def _once(bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once per text, sorted by text."""
    both = np.unique(text * BUCKETS + bucket)
    return both % BUCKETS, both // BUCKETS


def counts(labelled: DataFrame) -> DataFrame:
    """bucket, toxic, other: documents of either label with the bucket. ``labelled``: columns label (0, 1) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches, 1, 2 << 20):
            label = np.asarray(batch.column(0))
            bucket, text = _once(*buckets(batch.column(1)))
            for y in (0, 1):
                sums[y] += np.bincount(bucket[label[text] == y], minlength=BUCKETS)
        some = np.nonzero(sums.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[1][some]), pa.array(sums[0][some])], ["bucket", "toxic", "other"])

    each = labelled.select(F.col("label").cast("long"), "text").mapInArrow(run, "bucket long, toxic long, other long")
    return each.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


@dataclass(frozen=True)
class Linear:
    """The value of each bucket, weight times log-count ratio, and the intercept."""

    buckets: np.ndarray
    values: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.buckets] = self.values
        return out


#: A sparse vector as Parquet holds it, in the fields of VectorUDT.
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _vectors(labelled: DataFrame, chosen: np.ndarray, scale: np.ndarray) -> DataFrame:
    """label and, as a sparse vector by place in ``chosen``, the ratios of the chosen buckets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in slices(batches, 1, 2 << 20):
            bucket, text = buckets(batch.column(1))
            use = place[bucket] >= 0
            bucket, text = _once(bucket[use], text[use])
            at, rows = place[bucket], batch.num_rows
            bounds = pa.array(np.searchsorted(text, np.arange(rows + 1)), pa.int32())
            parts = [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, len(chosen), np.int32))]
            parts += [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (at, scale[at])]
            vector = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0), vector], ["label", "features"])

    rows = labelled.select(F.col("label").cast("double"), "text").mapInArrow(run, f"label double, features {SPARSE}")
    return stored(rows, "vectors", T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]))


def fit(labelled: DataFrame) -> Linear:
    """Fit on ``labelled``, a bounded table: columns label (0 or 1) and text. Without both labels the score is the label, or 0."""
    none = np.empty(0, np.int64)
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Linear(none, none.astype(float), 50.0 if toxic else -50.0)
    rate_t, rate_o = F.col("toxic") / toxic, F.col("other") / other
    pooled = (F.col("toxic") + F.col("other")) / (toxic + other)
    error = F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / other))
    clear = (F.col("toxic") + F.col("other") >= LEAST) & (F.abs(rate_t - rate_o) > CLEAR * error)
    grouped = stored(counts(labelled), "ratios")
    all_t, all_o, n = grouped.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0)), F.count("*")).first()
    ratio = F.log((F.col("toxic") + SMOOTH) / (all_t + SMOOTH * n)) - F.log((F.col("other") + SMOOTH) / (all_o + SMOOTH * n))
    found = grouped.where(clear).select("bucket", ratio.alias("ratio")).toArrow().sort_by("bucket")
    chosen, scale = found["bucket"].to_numpy(), found["ratio"].to_numpy()
    if not len(chosen):
        return Linear(none, none.astype(float), float(np.log(toxic / other)))
    regression = LogisticRegression(maxIter=STEPS, regParam=RIDGE, standardization=False, family="binomial")
    model = regression.fit(_vectors(labelled, chosen, scale))
    return Linear(chosen, model.coefficients.toArray() * scale, float(model.intercept))


def score(docs: DataFrame, model: Linear, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in slices(batches, 1, 2 << 20):
            bucket, text = buckets(batch.column(1))
            use = table[bucket] != 0
            bucket, text = _once(bucket[use], text[use])
            z = np.bincount(text, table[bucket], batch.num_rows) + model.intercept
            value = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], schema.names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0. Null
    and empty texts have no n-grams and get the intercept's score. Null labels
    and labels other than 0 and 1 are passed over; several labels of a document count
    once each. About ``fit_rows`` of them are drawn where there are more. Other columns are not read.
    """
    given = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & ~held_out(0, 5))
    parts = 1 << 20
    part = int(min(1.0, fit_rows / max(1, given.count())) * parts)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(parts)) < part
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where(drawn)
    model = fit(stored(texts.join(given.where(drawn), "doc_id").select("label", "text"), "labelled"))
    return score(docs, model, key, text).select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted")
