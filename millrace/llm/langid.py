"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each of its positions, one bit per language:
an n-gram has a few positions, and the bitwise AND of what stands there is the
set of all languages whose filter contains it, found in one look. A text's
n-grams are looked up, the set bits are counted per language, and the count is
corrected for the share of n-grams that a language's filter lets through by
chance. The largest corrected count decides.

A language's filter contains its n-grams, however rare: those that are at least ``contrast`` as frequent in it, by their share of all
its n-grams, as in the language where they are most frequent. So every n-gram is in some filter, whatever the
size of the corpus, and what a language only has from quoted or mislabelled foreign text is not taken for its own; without that rule all
filters would in the end contain everything. A filter's size follows from the counted number of its n-grams, up to MOST
positions: a language with more of them lets more foreign n-grams through by chance, which the correction takes into account,
but none of its own is ever missed. Counting runs over all training texts in Spark, and so does the making of the filter;
what leaves the cluster is the filter, 128 MB for up to 62 languages at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import held_out, slices, stored
from millrace.llm.letters import letter_codes

#: Least frequency of an n-gram in a language, in parts of its greatest one in any.
CONTRAST = 0.05
#: Positions per n-gram, positions of the table per n-gram of the fullest filter, and positions at most.
HASHES, SPACE, MOST = 3, 8, 1 << 24
#: Languages per word of the table.
WORD = 62
UNDETERMINED = "und"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All character trigrams around a letter, as numbers, and the text each is from; word ends are characters."""
    codes, text = letter_codes(texts)
    codes = codes.astype(np.int64)
    middle = np.nonzero(codes[1:-1])[0] + 1
    return (codes[middle - 1] << 42) | (codes[middle] << 21) | codes[middle + 1], text[middle]


def positions(grams: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th position of each n-gram in a table of ``size`` positions, a power of two."""
    x = grams.astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(size - 1)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """The languages, the most frequent one, and the sliced table: one row of language words per position."""

    languages: list[str]
    usual: int
    table: np.ndarray

    def rates(self) -> np.ndarray:
        """Per language the share of foreign n-grams that its filter lets through."""
        bits = [(self.table[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1) for i in range(len(self.languages))]
        return np.array([float(b.mean()) ** HASHES for b in bits])

    def counts(self, grams: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per text, and per text and language how many the filter contains, corrected for chance."""
        total = np.bincount(text, minlength=n).astype(float)
        out = np.zeros((n, len(self.languages)))
        starts = np.searchsorted(text, np.arange(n))
        some = np.nonzero(total)[0]
        at = [positions(grams, k, len(self.table)) for k in range(HASHES)]
        for word in range(self.table.shape[1]):
            slice_ = self.table[:, word]
            mask = slice_[at[0]]
            for k in range(1, HASHES):
                mask &= slice_[at[k]]
            for bit in range(min(WORD, len(self.languages) - word * WORD)):
                if len(some):
                    has = ((mask >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)
                    out[some, word * WORD + bit] = np.add.reduceat(has, starts[some])
        rate = self.rates()
        return total, np.maximum(0.0, (out - total[:, None] * rate) / np.maximum(1e-9, 1 - rate))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n of all rows. ``labelled``: columns lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams = np.concatenate([g for g, _ in parts[lang]])
            found, where = np.unique(grams, return_inverse=True)
            return found, np.bincount(where, np.concatenate([n for _, n in parts[lang]]), len(found)).astype(np.int64)

        for batch in slices(batches, 1, 2 << 20):
            grams, text = trigrams(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)[text]
            for lang in dict.fromkeys(batch.column(0).to_pylist()):
                found, n = np.unique(grams[langs == lang], return_counts=True)
                parts.setdefault(lang, []).append((found, n))
                if len(parts[lang]) > 8:
                    parts[lang] = [merged(lang)]
        for lang in parts:
            found, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

    each = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, contrast: float = CONTRAST) -> Filters:
    """Filters for all languages of ``labelled`` (columns lang and text, both without nulls)."""
    counts = stored(gram_counts(labelled), "grams")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if not totals:
        return Filters([], 0, np.zeros((2, 1), np.uint64))
    # One number per language: looked up, as a join would deal all n-grams by their few languages.
    total = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("lang"))
    rated = counts.withColumn("rate", F.col("n") / total)
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    frequent = stored(rated.join(most, "gram").where(F.col("rate") >= F.col("most") * contrast).drop("rate", "most"), "frequent")
    sizes = {r["lang"]: (totals[r["lang"]], r["kept"]) for r in frequent.groupBy("lang").agg(F.count("*").alias("kept")).collect()}
    languages = sorted(sizes)
    size = min(MOST, 1 << int(np.ceil(np.log2(SPACE * max(kept for _, kept in sizes.values())))))
    place = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))
    marked = frequent.select("gram", F.element_at(place, F.col("lang")).alias("i"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(HASHES):
                i = frame["i"].to_numpy(np.int64)
                yield pd.DataFrame({"at": positions(frame["gram"].to_numpy(), k, size), "word": i // WORD, "bit": np.int64(1) << (i % WORD)})

    bits = marked.mapInPandas(run, "at long, word long, bit long")
    found = bits.groupBy("at", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros((size, (len(languages) - 1) // WORD + 1), np.uint64)
    table[found["at"], found["word"]] = found["bits"].to_numpy().astype(np.uint64)
    usual = max(range(len(languages)), key=lambda i: sizes[languages[i]][0])
    return Filters(languages, usual, table)


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    The score is the language's share of all corrected counts. Equal counts: the
    language that sorts first. Letters that no filter knows: the language with most
    text, score 0. Null or no letter, or nothing learnt: ``und``, score 0.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*filters.languages, UNDETERMINED], object)
        for batch in slices(batches, 1, 2 << 20):
            grams, owner = trigrams(batch.column(1))
            total, counts = filters.counts(grams, owner, batch.num_rows) if filters.languages else (np.zeros(batch.num_rows), np.zeros((batch.num_rows, 1)))
            sums = counts.sum(axis=1)
            best = np.where(total == 0, len(filters.languages), np.where(sums > 0, counts.argmax(axis=1), filters.usual))
            score = np.where((total > 0) & (sums > 0), counts.max(axis=1) / np.maximum(sums, 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], schema.names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", contrast: float = CONTRAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learnt from the text and language of rows that have both and whose
    crc32(doc_id) mod 4 is not 2. Other columns are not read; an empty table gives an
    empty result.
    """
    known = docs.where(~held_out(2, 4, key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    filters = fit(known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")), contrast)
    return predict(docs, filters, key, text).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
