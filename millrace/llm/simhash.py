"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half the hashes of a document's
shingles have it, every repeat of a shingle counting. Documents whose
fingerprints differ in at most ``radius`` bits are linked, and linked documents
form a group.

Covering: give every bit position i a code c(i) from 1 to 2^(radius+1) - 1, in
turn. Table v, one for each such number, looks at the positions whose code has
an odd number of bits in common with v. ``radius`` differing positions leave a
v that is orthogonal to all their codes, and in that table both fingerprints
look the same: every pair within the radius meets, none is left to chance.

Equal fingerprints are one node. Within a bucket the pairs in reach are found
by comparing blocks or, in a large bucket, by looking up every fingerprint
that differs in one or two of the free positions, and only a star per connected set
leaves the task, so no bucket emits its pairs. A bucket of over ``bucket``
fingerprints is cut by a second covering of its free positions into radius + 1
parts by position, each dealt out by its value: a pair in reach agrees on one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import slices, stored, text_digest, without
from millrace.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints in a bucket above which it is cut by a second covering.
BUCKET = 2048
#: Above this many fingerprints a task looks neighbours up instead of comparing all.
COMPARE = 1024


def masks(radius: int) -> list[int]:
    """The bit masks of the tables, as unsigned numbers."""
    tables = 2 ** (radius + 1) - 1
    codes = [i % tables + 1 for i in range(BITS)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, tables + 1)]


def parts(mask: int, radius: int) -> list[int]:
    """The free positions of a table, cut into radius + 1 masks."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in free[p :: radius + 1]) for p in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: words are cut at ASCII white space, A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(plain[s:e], SEED) for s, e in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row: doc_id, the fingerprint as a signed long and a digest of the text. Null counts as empty; no words give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            raw = batch.column(2).cast(pa.large_binary()).to_pylist()
            marks = [signed(fingerprint(x or b"", shingle)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), batch.column(1)], schema.names)

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("mark", T.LongType()), T.StructField("digest", T.StringType())])
    return docs.select(F.col(key).alias("doc_id"), text_digest(text), F.col(text).cast("string")).mapInArrow(run, schema)


def _near(marks: np.ndarray, free: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted, distinct ``marks`` that differ in 1 to ``radius`` positions, block by block."""
    n = len(marks)
    if n <= COMPARE or radius > 2:
        for at in range(0, n, 256):
            part = marks[at : at + 256]
            far = np.bitwise_count(part[:, None] ^ marks[None, at:])
            i, j = np.nonzero(far <= radius)
            yield i[i < j] + at, j[i < j] + at
        return
    ones = [np.uint64(1 << i) for i in range(BITS) if free >> i & 1]
    flips = ones + [a | b for k, a in enumerate(ones) for b in ones[:k] if radius == 2]
    for flip in flips:
        wanted = marks ^ flip
        at = np.searchsorted(marks, wanted)
        at[at == n] = 0
        hit = np.nonzero((marks[at] == wanted) & (wanted > marks))[0]
        yield hit, at[hit]


def _stars(marks: np.ndarray, nodes: np.ndarray, free: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node to the smallest node that the bucket links it with."""
    order = np.argsort(marks)
    marks, nodes = marks[order], nodes[order]
    parent = np.arange(len(marks))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for left, right in _near(marks, free, radius):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    top = np.fromiter((root(i) for i in range(len(marks))), np.int64, len(marks))
    least = np.full(len(marks), np.iinfo(np.int64).max)
    np.minimum.at(least, top, nodes)
    low = least[top]
    return nodes[nodes != low], low[nodes != low]


def links(nodes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b that connect all nodes within ``radius`` bits. ``nodes``: long columns node and mark, marks distinct."""
    all_masks = masks(radius)
    looks = F.array(*(F.struct(F.lit(v).alias("v"), F.col("mark").bitwiseAND(F.lit(signed(m))).alias("look")) for v, m in enumerate(all_masks)))
    dealt = nodes.select("node", "mark", F.explode(looks).alias("t")).select("node", "mark", "t.*")
    large = dealt.groupBy("v", "look").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("v", "look", F.lit(True).alias("large"))
    dealt = dealt.join(stored(large, "buckets"), ["v", "look"], "left")
    pieces = F.array(*(F.array(*(F.lit(signed(p)) for p in parts(m, radius))) for m in all_masks))
    cut = F.when(
        F.col("large"),
        F.transform(F.get(pieces, F.col("v")), lambda p, i: F.struct(i.alias("part"), F.col("mark").bitwiseAND(p).alias("value"))),
    ).otherwise(F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value"))))
    dealt = dealt.withColumn("p", F.explode(cut)).select("node", "mark", "v", "look", "p.part", "p.value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            keys = frame[["v", "look", "part", "value"]].to_numpy()
            starts = np.r_[0, np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1]
            rest = frame.iloc[starts[-1] :]
            yield stars(frame, keys, starts)
        if rest is not None:
            yield stars(rest, rest[["v", "look", "part", "value"]].to_numpy(), np.array([0, len(rest)]))

    def stars(frame: pd.DataFrame, keys: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        marks, ids = frame["mark"].to_numpy().view(np.uint64), frame["node"].to_numpy()
        out = [(np.empty(0, np.int64),) * 2]
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s == 1:
                continue
            v, part = int(keys[s][0]), int(keys[s][2])
            free = ~all_masks[v] & ~(parts(all_masks[v], radius)[part] if part >= 0 else 0)
            out.append(_stars(marks[s:e], ids[s:e], free, radius))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})

    key = ["v", "look", "part", "value"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links lead to, its own included.
    Null text counts as empty; texts without words have fingerprint zero and
    link like any other. Rows without a doc_id link too; where no row that they lead to has
    one, the component is null. Rows that share a doc_id are linked by their own fingerprints only.
    Other columns are not read. ``key`` must be an integer column.
    """
    return _grouped(docs, key, text, shingle, radius, bucket).select("doc_id", "fingerprint", "component_id")


def _grouped(docs: DataFrame, key: str, text: str, shingle: int, radius: int, bucket: int) -> DataFrame:
    """doc_id, fingerprint, component_id, digest, and group, a fingerprint that stands for all that links reach."""
    marks = stored(fingerprints(docs, key, text, shingle), "marks")
    nodes = stored(marks.groupBy("mark").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select(F.col("mark").alias("node"), "mark"), radius, bucket))
    named = stored(nodes.join(found, nodes["mark"] == found["node"], "left").select("mark", F.coalesce("component", "mark").alias("group"), "least"), "named")
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(named.drop("least").join(ids, "group"), "groups")
    digits = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return marks.join(named, "mark", "left").select("doc_id", digits.alias("fingerprint"), "component_id", "digest", "group")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document per near-duplicate group: the one with the smallest identifier.

    Rows are judged by identifier and text, so a row that shares its identifier with a near copy but is near to nothing itself
    stays. Of different texts of a group under its smallest identifier the one with the smallest digest stays; rows that repeat its identifier
    and text are that document and stay with it. Rows without an identifier come last.
    """
    groups = stored(_grouped(docs, key, text, shingle, radius, bucket), "groups")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = groups.groupBy("group").agg(F.min(own).alias("best"))
    return without(docs, groups.join(best, "group").where(own != F.col("best")), key, text)
