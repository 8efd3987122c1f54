"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Rounds after which the search gives up with an error; each round at least halves long chains.
MAX_ROUNDS = 60


def _starred(edges: DataFrame) -> DataFrame:
    """Every edge, in both directions, with the smallest node around its first end.

    The minimum is a grouped aggregate joined back, not a window: Spark combines
    it before the shuffle. It is stored, so that both sides of the join are
    plain shuffles, which Spark splits where one node has many edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """Nodes with the smallest node of their component: columns node, component.

    ``edges`` has long columns a and b; loops and repeated edges do no harm, and
    only nodes with an edge come out. Each round joins every node's larger
    neighbours to its smallest one, then every node itself and its smaller
    neighbours, until only stars around the smallest nodes are left. Each round
    is stored in the shared folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "edges")
    state = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        large = _starred(now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(small.select("e.*").where("a <> b").distinct(), "edges")
        before, state = state, _fingerprint(now)
        if state == before:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    """Two numbers that stay as they are only if the edges do."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(mixed), F.lit(0)), F.coalesce(F.sum(F.shiftright(mixed, 24)), F.lit(0))).first())
