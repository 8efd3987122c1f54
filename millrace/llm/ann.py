"""Nearest neighbours by largest inner product with an adaptive dimension scan.

Vectors get one more component, so that the nearest vector by distance is the one
with the largest inner product, and a random rotation, so that the first
components of a difference tell its length. Lists around centroids are fitted on a
bounded sample; every vector is in the list of its nearest centroid.

A query looks through its nearest lists. Within a list the vectors lie in blocks of
columns. After each block a candidate is dropped if its partial distance,
scaled up to all columns, is beyond the best distances found so far by more
than chance explains: the hypothesis that it is still among the best is rejected
at ``DEVIATIONS`` standard deviations. Survivors are scored exactly, in double precision on
the original vectors. What a query must beat from the start is a product that more
than enough entries of the sample in its lists reach, which are candidates themselves.

Equal vectors are one entry with its smallest identifiers: any query can only
want so many of them. So a vector that a third of all rows share costs as much as
any other. Lists are cut into chunks and packed into bundles, and the queries of a bundle into blocks.
A task holds one bundle and one block, compares them in tiles and returns at most k + 1 entries per query.

How many lists a query needs is measured on the sample: as many as hold nearly all
neighbours of sample queries found by brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import stored

#: Entries, in expectation, that centroids and the number of lists to look through are fitted on.
SAMPLE, TRIALS = 20_000, 256
MAX_LISTS = 4096
#: Share of the sample's true neighbours that the lists looked through must hold.
REACH = 0.98
BLOCK = 16
DEVIATIONS = 2.1
#: Vectors per chunk of a list, candidates that are measured in full first.
CHUNK, FIRST = 4096, 64
#: Bundles of a large table at least; components and rows of a bundle or a block of queries, and rows of a block that wide vectors do not lessen.
BUNDLES, BUNDLE, ROWS, QUERIES = 16, 2 << 20, 1 << 15, 1024
#: Pairs of a query and a vector in a tile, pairs of a query and a list that are ranked at once, components that are scored at once.
TILE, RANKED, SCORED = 1 << 18, 1 << 20, 2 << 20
#: Candidates are followed one by one where fewer than one in so many is left in a tile.
FEW = 16
#: Rounding of square distances, as a share of the squares of the vectors.
ROUNDING = 1e-11
#: Entries of the sample that give each query its first bound.
BOUND = 8192
#: Components that a task holds while it merges equal vectors, of which each counts as 64 at least.
HELD = 4 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """The vectors of a column as rows in double precision."""
    return np.stack(column.to_numpy()).astype(float, copy=False)


def entries(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their k smallest identifiers, and the queries among the rows.

    ``vectors``: columns id and vector, all usable. Each input partition first
    merges its own equal vectors, so a hot one sends one row per partition.
    """
    vector_type = vectors.schema["vector"].dataType.simpleString()
    kind = np.float32 if vector_type == "array<float>" else np.float64

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, tuple[list[int], list[int]]] = {}

        def out() -> pd.DataFrame:
            rows = [(np.frombuffer(v, kind), sorted(set(ids))[:k], queries) for v, (ids, queries) in found.items()]
            return pd.DataFrame(rows, columns=["vector", "ids", "queries"])

        for frame in frames:
            for i, vector in zip(frame["id"].tolist(), frame["vector"], strict=True):
                ids, queries = found.setdefault((np.asarray(vector, kind) + kind(0)).tobytes(), ([], []))
                ids.append(i)
                if i % every == 0:
                    queries.append(i)
                if len(ids) > 4 * k:
                    ids[:] = sorted(set(ids))[:k]
                if len(found) * max(64, len(vector)) > HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()

    parts = stored(vectors.mapInPandas(run, f"vector {vector_type}, ids array<long>, queries array<long>"), "parts")
    merged = parts.groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.max(F.size("queries") > 0).alias("asks"))
    merged = merged.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k).alias("ids"), "asks").withColumn("node", F.get("ids", F.lit(0)))
    return stored(merged, "entries"), parts.where(F.size("queries") > 0).select("vector", "queries")


@dataclass(frozen=True)
class Index:
    """The rotation, the square of the largest norm, the centroids in rotated space, and the lists to look through."""

    rotation: np.ndarray
    largest: float
    centroids: np.ndarray
    probes: int

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors; as entries they are lengthened to the largest norm, as queries they are not."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.largest - (x * x).sum(axis=1)))
        return np.concatenate([x, more[:, None]], axis=1) @ self.rotation

    def far(self, turned: np.ndarray) -> np.ndarray:
        """Square distances to the centroids, less the square of the vector."""
        return (self.centroids**2).sum(axis=1) - 2 * turned @ self.centroids.T


def fit(sample: np.ndarray, total: int, largest: float, k: int, seed: int = 3) -> Index:
    """Centroids by Lloyd's rounds on a sample of the entries, and the number of lists to look through."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    rotation, _ = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))
    lists = max(1, min(MAX_LISTS, int(math.sqrt(total)), n // 8 or 1))
    index = Index(rotation, largest, np.zeros((1, dim + 1)), 1)
    x = index.turned(sample)
    centroids = x[rng.choice(n, lists, replace=False)]
    for _ in range(10):
        near = _nearest(x, centroids)
        size = np.bincount(near, minlength=lists)
        sums = np.stack([np.bincount(near, x[:, d], lists) for d in range(dim + 1)], axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], x[rng.choice(n, lists)])
    index = Index(rotation, largest, centroids, 1)
    asked = rng.choice(n, min(TRIALS, n), replace=False)
    products = sample[asked] @ sample.T
    products[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-products, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)] if n > 1 else np.zeros((len(asked), 0), int)
    rank = np.argsort(np.argsort(index.far(index.turned(sample[asked], True)), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, _nearest(x, centroids)[best], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(REACH * len(needed)))]) + 1 if len(needed) else lists
    return Index(rotation, largest, centroids, max(probes, min(4, lists)))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norm = (centroids**2).sum(axis=1)
    step = max(64, min(4096, RANKED // len(centroids)))
    return np.concatenate([np.argmin(norm - 2 * x[i : i + step] @ centroids.T, axis=1) for i in range(0, len(x), step)])


def bounds(queries: np.ndarray, sample: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """A product that at least k entries reach which the query will meet; -inf if it meets fewer of the sample.

    ``near`` tells for each query and entry of the sample whether the entry's list is looked through.
    """
    if len(sample) < k:
        return np.full(len(queries), -np.inf)
    slack = 1e-12 * np.sqrt((queries**2).sum(axis=1)) * np.sqrt((sample**2).sum(axis=1).max())
    products = np.where(near, queries @ sample.T, -np.inf)
    return np.partition(products, len(sample) - k, axis=1)[:, len(sample) - k] - slack


@dataclass(frozen=True)
class Layout:
    """Where the vectors of a list lie: its chunks, and the bundles that hold them one after the other."""

    chunks: np.ndarray
    start: np.ndarray
    unit: np.ndarray
    per: int

    @staticmethod
    def of(held: np.ndarray, dim: int) -> Layout:
        """``held`` are the entries of each list."""
        chunks = np.maximum(1, -(-held // CHUNK))
        total = int(held.sum())
        return Layout(chunks, np.cumsum(held) - held, held // chunks, max(1, min(-(-total // BUNDLES), max(CHUNK, min(ROWS, BUNDLE // dim)))))

    def bundles(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last bundle of each list."""
        first = self.start[lists]
        return first // self.per, (first + (self.chunks[lists] - 1) * self.unit[lists]) // self.per


def halves(turned: np.ndarray, query: bool = False) -> list[np.ndarray]:
    """Rotated vectors in blocks of columns, each with two more, so that the product of a query's and an entry's is their square distance in the block."""
    out = []
    for i in range(0, turned.shape[1], BLOCK):
        b = turned[:, i : i + BLOCK]
        square, one = (b * b).sum(axis=1)[:, None], np.ones((len(b), 1))
        out.append(np.concatenate([-2 * b, one, square] if query else [b, square, one], axis=1))
    return out


def limits(query: np.ndarray, turned: np.ndarray, bound: np.ndarray, largest: float, chunk: np.ndarray, k: int) -> np.ndarray:
    """The square distance that a candidate of a chunk is tested against, for each query; infinite if all are to be measured.

    ``chunk`` are its rotated vectors in the order of their nodes.
    """
    if len(chunk) <= max(FIRST, k):
        return np.full(len(query), np.inf)
    limit = (query**2).sum(axis=1) + largest - 2 * bound
    for i in np.flatnonzero(limit == np.inf):
        full = ((chunk[: max(FIRST, k)] - turned[i]) ** 2).sum(axis=1)
        limit[i] = np.partition(full, k - 1)[k - 1]
    return limit


def scan(
    query: np.ndarray, q_blocks: list[np.ndarray], limit: np.ndarray, least: np.ndarray, largest: float, vectors: np.ndarray, blocks: list[np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query those of a chunk that pass the tests against ``limit``, reach the product ``least`` and are among the k best.

    Rows of the queries, places in the chunk and exact inner products; more than k where products are nearly equal.
    ``q_blocks`` and ``blocks`` are the ``halves`` of queries and vectors. A tile is measured as a whole while many candidates are left.
    """
    widths = [b.shape[1] - 2 for b in blocks]
    dim, done = sum(widths), 0
    scale = (query**2).sum(axis=1) + largest
    part, stay = np.zeros((len(query), len(vectors))), np.ones((len(query), len(vectors)), bool)
    row = at = None
    for width, mine, its in zip(widths, q_blocks, blocks, strict=True):
        part += mine @ its.T if at is None else (mine[row] * its[at]).sum(axis=1)
        done += width
        if done < dim:
            bar = limit * (done / dim) * (1 + DEVIATIONS / math.sqrt(done)) ** 2 + ROUNDING * scale
        else:
            bar = scale - 2 * least + ROUNDING * scale
        if at is None:
            stay &= ~(part > bar[:, None])
            if np.count_nonzero(stay) * FEW < stay.size:
                row, at = np.nonzero(stay)
                part = part[row, at]
        else:
            inside = ~(part > bar[row])
            row, at, part = row[inside], at[inside], part[inside]
    if at is None:
        many = np.flatnonzero(np.count_nonzero(stay, axis=1) > k)
        if len(many):
            far = np.where(stay[many], part[many], np.inf)
            worst = np.partition(far, k - 1, axis=1)[:, k - 1] + ROUNDING * scale[many]
            stay[many] &= ~(far > worst[:, None])
        row, at = np.nonzero(stay)
    step = max(1, SCORED // query.shape[1])
    product = np.concatenate([(vectors[at[i : i + step]] * query[row[i : i + step]]).sum(axis=1) for i in range(0, max(1, len(at)), step)])
    inside = product >= least[row]
    return row[inside], at[inside], product[inside]


class Best:
    """The k best entries of each query so far, ties by node, and the product that an entry must reach to be one of them."""

    def __init__(self, bound: np.ndarray, nodes: np.ndarray, k: int) -> None:
        self.least, self.nodes, self.k = bound.copy(), nodes, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept = self.waiting = 0

    def add(self, row: np.ndarray, at: np.ndarray, product: np.ndarray) -> None:
        self.parts.append((row.astype(np.int32), at.astype(np.int32), product))
        self.waiting += len(row)
        if self.waiting > max(self.kept, len(self.least) * self.k // 2):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the queries in order, places of their best entries, products."""
        row, at, product = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
        order, rank = ranked_by(row, -product, self.nodes[at])
        full = order[rank == self.k - 1]
        order = order[rank < self.k]
        self.least[row[full]] = np.maximum(self.least[row[full]], product[full])
        self.parts = [(row[order], at[order], product[order])]
        self.kept, self.waiting = len(order), 0
        return self.parts[0]


def ranked_by(row: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by row and ``keys``, and the places from 0 within each row."""
    order = np.lexsort((*keys[::-1], row))
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return order, np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest rows of every row whose identifier is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, the row itself is no neighbour, ties go to
    the smaller identifier. Vectors that are null, empty or zero, or hold
    null or non-finite components take no part, nor do those of another length
    than most, or rows without an identifier. Rows that repeat identifier and vector count
    once as a neighbour and once as a query. Fewer other rows than k: all of them. Without
    usable rows the result is empty. Other columns are not read.
    """
    column = vectors.schema[vector].dataType
    # single precision, where given, is half as much to store and to shuffle
    vector_type = "array<float>" if isinstance(column, T.ArrayType) and isinstance(column.elementType, T.FloatType) else "array<double>"
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(vector_type).alias("vector"))
    good = given.where(F.col("id").isNotNull() & usable(F.col("vector")))
    out = "query_id long, rank int, vec_id long, score double"
    lengths = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], out)
    nodes, asked = entries(good.where(F.size("vector") == lengths["n"]), k + 1, every)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, largest = nodes.agg(F.count("*"), F.max(norm)).first()
    parts = 1 << 20
    chosen = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(parts)) < int(min(1.0, SAMPLE / total) * parts + 1)
    sample = nodes.where(chosen).select("node", "vector").orderBy("node").toPandas()
    if not len(sample):
        sample = nodes.select("node", "vector").orderBy("node").limit(1).toPandas()
    sample = matrix(sample["vector"])
    index, first = fit(sample, total, largest, k), sample[:BOUND]
    first_list = _nearest(index.turned(first), index.centroids)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = index.turned(matrix(frame["vector"]))
                yield frame.assign(list=_nearest(x, index.centroids).astype(np.int32))

    # Found twice rather than stored with the vectors: first its lists are counted, then it is dealt out.
    listed = nodes.mapInPandas(place, f"vector {vector_type}, ids array<long>, asks boolean, node long, list int")
    sizes, held_by = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("entries")).collect():
        sizes[r["list"]], held_by[r["list"]] = r["n"], r["entries"]
    layout = Layout.of(held_by, sample.shape[1])

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(256, RANKED // len(index.centroids) // 256 * 256)
        for frame in frames:
            for start in range(0, len(frame), step):
                part = frame.iloc[start : start + step]
                x = matrix(part["vector"])
                order = np.argsort(index.far(index.turned(x, True)), axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                # As many lists as measured, and more where those hold too few vectors.
                count = np.maximum(index.probes, (held < 4 * (k + 1)).sum(axis=1) + 1).clip(max=order.shape[1])
                rank = np.argsort(order, axis=1)
                ranges = range(0, len(x), 256)
                bound = np.concatenate([bounds(x[i : i + 256], first, rank[i : i + 256][:, first_list] < count[i : i + 256, None], 2 * (k + 1)) for i in ranges])
                row = np.repeat(np.arange(len(x)), count)
                lists = order[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
                low, high = layout.bundles(lists)
                times = high - low + 1
                row, lists, low = np.repeat(row, times), np.repeat(lists, times).astype(np.int32), np.repeat(low, times)
                bundle = low + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                sort = np.lexsort((bundle, row))
                row, lists, bundle = row[sort], lists[sort], bundle[sort]
                new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(bundle, prepend=-1) != 0))
                ends = np.append(new[1:], len(row))
                vector, node = part["vector"].to_numpy(), part["node"].to_numpy()
                for i in range(0, len(new), layout.per):
                    at, end = new[i : i + layout.per], ends[i : i + layout.per]
                    yield pd.DataFrame(
                        {"vector": vector[row[at]], "node": node[row[at]], "bound": bound[row[at]], "bundle": bundle[at], "lists": [lists[s:e] for s, e in zip(at, end, strict=True)]}
                    )

    asking = nodes.where("asks").select("vector", "node")
    probes = stored(asking.mapInPandas(probe, f"vector {vector_type}, node long, bound double, bundle long, lists array<int>"), "probes")
    blocks = probes.groupBy("bundle").agg(F.ceil(F.count("*") / max(QUERIES, min(ROWS, BUNDLE // sample.shape[1]))).cast("int").alias("blocks"))
    blocks = stored(blocks, "blocks")
    rows = zip(range(len(held_by)), *(x.tolist() for x in (layout.chunks, layout.start, layout.unit)), strict=True)
    places = vectors.sparkSession.createDataFrame(list(rows), "list int, chunks long, start long, unit long")
    chunked = listed.join(F.broadcast(places), "list").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    chunked = chunked.withColumn("bundle", F.call_function("div", F.col("start") + F.col("chunk") * F.col("unit"), F.lit(layout.per)))
    held = chunked.join(blocks, "bundle").select("vector", "ids", "node", "list", "chunk", "bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    want = probes.join(blocks, "bundle").select("vector", "node", "bound", "lists", "bundle", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))

    def look(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"node": [], "far": [], "id": []})
        held = held.sort_values(["list", "chunk", "node"])
        # Rotated, and in double precision, only chunk by chunk and tile by tile.
        x, q, bound = np.stack(held["vector"].to_numpy()), np.stack(queries["vector"].to_numpy()), queries["bound"].to_numpy()
        lists, chunk, ids = held["list"].to_numpy(), held["chunk"].to_numpy(), held["ids"].to_numpy()
        asked_lists = np.concatenate(queries["lists"].to_numpy())
        asking = np.repeat(np.arange(len(q)), [len(x) for x in queries["lists"]])
        by_list = np.argsort(asked_lists, kind="stable")
        asked_lists, asking = asked_lists[by_list], asking[by_list]
        best = Best(bound, held["node"].to_numpy(), k + 1)
        starts = np.flatnonzero((np.diff(lists, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            mine, its = asking[slice(*np.searchsorted(asked_lists, [lists[s], lists[s] + 1]))], x[s:e].astype(float)
            turned = index.turned(its)
            blocks, most, step = halves(turned), min(k + 1, e - s), max(1, TILE // (e - s))
            for i in range(0, len(mine), step):
                at = mine[i : i + step]
                asks = q[at].astype(float)
                q_turned = index.turned(asks, True)
                limit = limits(asks, q_turned, bound[at], index.largest, turned, most)
                row, place, product = scan(asks, halves(q_turned, True), limit, best.least[at], index.largest, its, blocks, most)
                best.add(at[row], place + s, product)
        row, at, product = best.cut()
        del x, q
        node, out = queries["node"].to_numpy(), []
        for i in range(0, len(queries), CHUNK):
            some = slice(*np.searchsorted(row, [i, i + CHUNK]))
            each = np.fromiter((len(ids[j]) for j in at[some].tolist()), np.int64, some.stop - some.start)
            flat = np.concatenate([ids[j] for j in at[some].tolist()]) if len(each) else np.empty(0, np.int64)
            whose, far = np.repeat(row[some], each), np.repeat(-product[some], each)
            order, rank = ranked_by(whose, far, flat)
            order = order[rank <= k]
            out.append(pd.DataFrame({"node": node[whose[order]], "far": far[order], "id": flat[order]}))
        return pd.concat(out)

    by = ["bundle", "block"]
    # One task for a bundle and a block, not as few as their bytes ask for.
    tasks = max(1, min(10_000, 2 * (blocks.agg(F.sum("blocks")).first()[0] or 0)))
    found = want.repartition(tasks, *by).groupBy(*by).cogroup(held.repartition(tasks, *by).groupBy(*by)).applyInPandas(look, "node long, far double, id long")
    # A window keeps k + 1 rows per query, however many bundles there are.
    first_rows = found.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy("far", "id"))).where(F.col("_place") <= k + 1)
    best = first_rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("best"))
    results = stored(best.join(nodes.where("asks").select("node", "vector"), "node").select("vector", "best"), "best")
    each = asked.join(results, "vector").select(F.explode(F.array_distinct("queries")).alias("query_id"), "best")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    ranked = each.distinct().select("query_id", F.posexplode(others).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.far")).alias("score"))
