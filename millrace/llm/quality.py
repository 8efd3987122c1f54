"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance
and a multiple of the identity. A document's score is the difference of the two
log densities, each a Mahalanobis distance taken with the class's cached
Cholesky factor, turned into a probability with the class shares as priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import held_out, slices, stored, text_digest, without

#: The statistics of a text, in the order of the vector.
STATISTICS = [
    "log_words", "log_chars_per_word", "letters", "digits", "marks", "symbols", "upper", "distinct_words",
    "top_word", "repeated_next", "distinct_lines", "log_words_per_line", "marked_words", "rare_pairs",
]
#: Weight of the pooled covariance, and of its mean variance on the diagonal.
POOL, RIDGE = 0.1, 0.01
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """A class per byte: 0 space, 1 lower-case or non-ASCII, 2 upper-case, 3 digit, 4 sentence mark, 5 other symbol."""
    kinds = np.full(256, 5)
    kinds[128:] = 1
    for text, kind in ((b" \t\n\r\x0b\x0c", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3), (b".,;:'\"?-()", 4)):
        kinds[list(text)] = kind
    return kinds


def statistics(text: bytes, kinds: np.ndarray) -> list[float]:
    """Transformed statistics of one whole text: counts as logarithms, shares as arcsine roots."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    by = np.bincount(kinds, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 6)
    chars = max(1.0, by[1:].sum())
    letters = by[1] + by[2]
    low = [w.lower() for w in words]
    counts = Counter(low)
    lines = [x for x in text.split(b"\n") if x]
    pairs = Counter(zip(low, low[1:], strict=False))
    shares = (
        letters / chars,
        by[3] / chars,
        by[4] / chars,
        by[5] / chars,
        by[2] / max(1.0, letters),
        len(counts) / n,
        (max(counts.values()) - 1) / n,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        (len(set(lines)) + 1) / (len(lines) + 1),
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        (len(pairs) + 1) / n if n > 1 else 1.0,
    )
    a = [float(np.arcsin(np.sqrt(min(1.0, x)))) for x in shares]
    return [
        float(np.log1p(n)), float(np.log(len(text) / n)), *a[:9], float(np.log1p(n / max(1, len(lines)))), *a[9:],
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a digest of the text and the vector of statistics of every row; null counts as empty, an empty text gives zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in slices(batches, 2):
            raw = batch.column(2).cast(pa.large_binary()).to_pylist()
            found = [statistics(x or b"", kinds) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], schema.names)

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("digest", T.StringType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(key).alias("doc_id"), text_digest(text), F.col(text).cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log shares of classes 0 and 1; empty without both classes."""

    constant: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    logs: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if not self.means:
            return np.full(len(x), self.constant)
        density = [
            shift - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, shift in zip(self.means, self.factors, self.logs, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """Fit on columns ``stats`` and ``label`` (0 or 1) of all given rows.

    Two grouped aggregates give the class counts, means and covariances. With
    rows of one class only the score is that class; without rows it is 0.5.
    """
    p = len(STATISTICS)
    at = [F.get("stats", F.lit(i)) for i in range(p)]
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    grouped = labelled.where(F.col("label").isin(0, 1)).groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*(F.avg(x) for x in at)).alias("mean"),
        F.array(*(F.covar_pop(at[i], at[j]) for i, j in cells)).alias("cov"),
    )
    rows = {r["label"]: r for r in grouped.collect()}
    if len(rows) < 2:
        return Discriminant(float(next(iter(rows), 0.5)))
    total = sum(r["n"] for r in rows.values())
    covariance = {}
    for label, r in rows.items():
        full = np.zeros((p, p))
        for (i, j), value in zip(cells, r["cov"], strict=True):
            full[i, j] = full[j, i] = value
        covariance[label] = full
    pooled = sum(r["n"] / total * covariance[label] for label, r in rows.items())
    floor = ridge * max(np.trace(pooled) / p, 1e-6) * np.eye(p)
    means, factors, logs = [], [], []
    for label in (0, 1):
        shrunk = (1 - pool) * covariance[label] + pool * pooled + floor
        lower = np.linalg.cholesky(shrunk)
        means.append(np.array(rows[label]["mean"]))
        factors.append(np.linalg.inv(lower))
        logs.append(float(np.log(rows[label]["n"] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(0.5, tuple(means), tuple(factors), tuple(logs))


def score(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` without the vector, with score and predicted."""
    keep = [c for c in stats.columns if c != "stats"]
    schema = T.StructType([*(stats.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                value = model.score(np.stack(frame["stats"].to_numpy()))
                yield frame[keep].assign(score=value, predicted=(value >= threshold).astype(np.int32))

    return stats.mapInPandas(run, schema)


def _scored(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    stats = stored(document_statistics(docs, key, text).withColumn("held_out", held_out(0, 5)), "statistics")
    given = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("label"))
    model = fit(stats.where(~F.col("held_out")).join(given, "doc_id"))
    return score(stats, model)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0. A null
    text counts as empty, an empty one has the statistics zero. Null labels and
    labels other than 0 and 1 are passed over; several labels of a document
    count once each. Rows that share a doc_id are scored each by its own text. Other columns are not read.
    """
    return _scored(docs, labels, key, text, label).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected.

    Each row is judged by its own text: of rows that share a key, or have none, only those with a rejected text go.
    """
    return without(docs, _scored(docs, labels, key, text, "quality").where("predicted = 0"), key, text)
