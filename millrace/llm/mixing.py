"""Mixing sources to target weights by temperature.

A source with the token share p gets a weight in proportion to p^x. The exponent
x is found by bisection over one table with a row per source: it meets a target
entropy (as a share of the greatest possible one), or it is the least exponent
at which no source is repeated more often than ``repeat``. Without a ``budget`` of
tokens the mixture is as large as it must be for every source to be used up at
least once, so nothing is dropped.

A source's budget is realised by block permutations: its documents are dealt to
``blocks`` by a hash, blocks stand in a random order, and so do the documents in
each. Whole passes come first; the last, partial pass takes documents in that
order while their tokens fit. The document at which it ends is found by summing
tokens per block, then per part of the one block in question, then over the few
rows of that part, so no task sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

BLOCKS = 1024
#: Exponents tried at once in a round of the bisection, and the width at which it ends.
TRIES, WIDTH = 63, 1e-13
REPEAT = 4.0
#: Low bits of a draw within a part of a block.
PART = 50


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _draw(*parts: Column | str) -> Column:
    """A random number of 60 bits from the given parts, the same in any SQL that has md5."""
    said = F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("null")) if isinstance(x, Column) else F.lit(x) for x in parts))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def _exponent(sources: DataFrame, entropy: float | None, repeat: float, budget: float | None) -> float:
    """The exponent that meets the target; ``sources`` has a column t, the tokens of a source, all above 0.

    Both the entropy and the most repeated source fall as the exponent grows
    from 0 to 1, so the target is met at the end of the bracket, if it cannot
    be met inside it.
    """
    total, least, most, count = sources.agg(F.sum("t"), F.min("t"), F.max("t"), F.count("*")).first()
    if not count or least == most:
        return 1.0
    log = F.log(F.col("t") / F.lit(float(total)))
    low, high = 0.0, 1.0

    def too_flat(x: float, z: float, zl: float) -> bool:
        """Whether the exponent must grow, from the sums of p^x and p^x log p."""
        if entropy is not None:
            return math.log(z) - x * zl / z > entropy * math.log(count)
        at_least, at_most = (x - 1) * math.log(least / total), (x - 1) * math.log(most / total)
        scale = at_least - at_most if budget is None else at_least + math.log(budget / total) - math.log(z)
        return scale > math.log(repeat)

    while high - low > WIDTH:
        xs = [low + (high - low) * i / (TRIES + 1) for i in range(1, TRIES + 1)]
        tried = sources.select("t", F.explode(F.lit(xs)).alias("x")).groupBy("x").agg(F.sum(F.exp(log * F.col("x"))), F.sum(F.exp(log * F.col("x")) * log))
        sums = {x: (z, zl) for x, z, zl in tried.collect()}
        flat = [too_flat(x, *sums[x]) for x in xs]
        at = flat.index(False) if False in flat else len(xs)
        low, high = ([low, *xs])[at], ([*xs, high])[at]
    return high if high < 1.0 else 1.0


def plan(docs: DataFrame, entropy: float | None, repeat: float, budget: float | None, blocks: int, seed: int) -> DataFrame:
    """Per source: its tokens, weight, whole passes and the place in its permutation where the last pass ends.

    ``docs``: columns id, source, n (tokens). Stored; one row per source.
    """
    sources = stored(docs.groupBy("source").agg(F.sum("n").alias("t")), "sources")
    used = sources.where("t > 0")
    x = _exponent(used, entropy, repeat, budget)
    total, most = used.agg(F.sum("t"), F.max("t")).first()
    if not total:
        return sources.select("source", "t", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(None).cast(ORDER).alias("end"))
    power = F.when(F.col("t") > 0, F.exp(F.log(F.col("t") / F.lit(float(total))) * x)).otherwise(0.0)
    norm = used.agg(F.sum(power)).first()[0]
    weight = power / F.lit(norm)
    whole = F.lit(float(budget)) if budget is not None else F.lit(most / (most / total) ** x * norm)
    times = F.round(whole * weight / F.col("t"), 9)
    sources = sources.select(
        "source", "t", F.round(weight, 9).alias("weight"),
        F.when(F.col("t") > 0, F.floor(times)).otherwise(1).cast("long").alias("passes"),
        F.when(F.col("t") > 0, F.floor((times - F.floor(times)) * F.col("t") + 1e-6)).otherwise(0).cast("long").alias("left"),
    )
    sources = stored(sources, "weights")
    placed = docs.select("source", "n", order(blocks, seed).alias("o"))

    by_block = placed.groupBy("source", F.struct("o.deal", "o.block").alias("at")).agg(F.sum("n").alias("n"))
    first = _reached(by_block, sources)
    inside = placed.alias("d").join(first.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.o.block") == F.col("f.at.block")))
    inside = stored(inside.select("d.source", "d.n", "d.o", "f.left"), "block")
    rest = inside.groupBy("source").agg(F.max("left").alias("left"), F.max("o.deal").alias("deal"), F.max("o.block").alias("block"))
    by_part = inside.groupBy("source", F.shiftright("o.draw", PART).alias("at")).agg(F.sum("n").alias("n"))
    second = stored(_reached(by_part, rest), "part")
    cut = inside.drop("left").alias("d").join(second.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.shiftright("d.o.draw", PART) == F.col("f.at")))
    running = F.sum("d.n").over(Window.partitionBy("d.source").orderBy("d.o"))
    taken = cut.select("d.source", "d.o", "f.left", running.alias("run")).where("run <= left").groupBy("source").agg(F.max("o").alias("last"))
    start = F.struct("r.deal", "r.block", F.shiftleft("f.at", PART).alias("draw"), F.lit(None).cast("long").alias("id"))
    by = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    found = sources.alias("s").join(second.alias("f"), by("s", "f"), "left").join(rest.alias("r"), by("s", "r"), "left").join(taken.alias("e"), by("s", "e"), "left")
    end = F.coalesce("e.last", F.when(F.col("f.at").isNotNull(), start))
    return stored(found.select("s.source", "s.t", "s.weight", "s.passes", end.alias("end")), "plan")


ORDER = "struct<deal:bigint,block:bigint,draw:bigint,id:bigint>"


def order(blocks: int, seed: int) -> Column:
    """A document's place in the permutation of its source: the block's draw, the block, its own draw, its identifier."""
    block = F.pmod(_draw(F.col("id"), f"block {seed}"), F.lit(blocks))
    return F.struct(
        _draw(F.col("source"), block, f"deal {seed}").alias("deal"), block.alias("block"), _draw(F.col("id"), f"draw {seed}").alias("draw"), F.col("id")
    )


def _reached(sums: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the first ``at`` whose running sum goes beyond what is left, and what is left before it."""
    mine = sums.join(sources.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    run = mine.withColumn("run", F.sum("n").over(Window.partitionBy("source").orderBy("at")))
    return run.where(F.col("run") > F.col("left")).groupBy("source").agg(
        F.min_by(F.struct("at", (F.col("left") - F.col("run") + F.col("n")).alias("left")), "at").alias("x")
    ).select("source", "x.*")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy: float | None = None,
    repeat: float = REPEAT, budget: float | None = None, blocks: int = BLOCKS, seed: int = 7, carry: tuple[str, ...] = (), places: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, weight of the source, copies; then the columns of ``carry``.

    ``places`` adds block and position, where the row stands in the permutation of its source, from 0; its k-th copy
    stands there in the k-th pass, so sorting by pass and position is the mixture's order.

    A null source is a source of its own. Texts without words take no tokens;
    a source that has no others keeps each row once, with weight 0. Rows that
    share identifier and source stand at the same place and are taken or left
    together. An empty table gives an empty result. ``key`` must be an integer
    column. ``entropy`` (0 to 1) goes before ``repeat``.
    """
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), n_tokens(F.col(text)).alias("n"), *kept)
    counted = stored(given.select("id", "source", "n"), "tokens")
    plans = plan(counted, entropy, repeat, budget, blocks, seed)
    found = (given if carry else counted).alias("d").join(plans.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    found = found.select("d.*", "p.weight", "p.passes", "p.end").withColumn("o", order(blocks, seed))
    copies = F.col("passes") + F.coalesce(F.col("o") <= F.col("end"), F.lit(False)).cast("long")
    more = [F.col(f"c{i}") for i in range(len(carry))]
    if places:
        found, more = _with_places(found, counted, blocks, seed), [*more, F.col("o.block").alias("block"), "position"]
    return found.select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), "weight", copies.alias("copies"), *more)


def _with_places(found: DataFrame, counted: DataFrame, blocks: int, seed: int) -> DataFrame:
    """``found`` with the position of each row: the rows of the blocks before its own, and those before it in its block.

    A window over a source holds a row per block, the one over a block narrow rows; rows of the same identifier share a place.
    """
    placed = counted.select("source", order(blocks, seed).alias("o"))
    sizes = placed.groupBy("source", F.col("o.block").alias("b"), F.col("o.deal").alias("deal")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("deal", "b")) - F.col("n")
    starts = sizes.select(F.col("source").alias("of"), "b", before.alias("start"))
    joined = found.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("o.block") == F.col("b"))).drop("of", "b")
    inside = F.rank().over(Window.partitionBy("source", "o.block").orderBy("o.draw", "o.id"))
    return joined.withColumn("position", F.col("start") + inside - 1)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mixture has it."""
    found = mix(docs, key, text, source, carry=tuple(docs.columns), **settings)
    rows = found.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _sql_draw(said: str) -> str:
    return f"('0x' || substr(md5({said}), 1, 15))::BIGINT"


def _sql(x: str, scale: str, more: str = "") -> str:
    """The mixture with the exponent ``x`` and the tokens ``scale``, both expressions over the sums m of the sources s."""
    deal = _sql_draw("o.source || ':' || block || ':deal 7'")
    return f"""WITH RECURSIVE d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n FROM documents),
o AS (SELECT *, {_sql_draw("id || ':block 7'")} % {BLOCKS} AS block, {_sql_draw("id || ':draw 7'")} AS draw FROM d),
s AS (SELECT source, sum(n) AS t FROM d GROUP BY 1),
m AS (SELECT sum(t)::DOUBLE AS total, max(t)::DOUBLE AS most, min(t)::DOUBLE AS least, count(*) AS k FROM s){more},
x AS (SELECT {x} AS x FROM m),
w AS (SELECT source, t, weight, round({scale} * weight / t, 9) AS times FROM
    (SELECT source, t, pow(t / total, x) / sum(pow(t / total, x)) OVER () AS weight, sum(pow(t / total, x)) OVER () AS norm, total, most, x FROM s, m, x)),
r AS (SELECT o.*, weight, floor(times) AS passes, floor((times - floor(times)) * t + 1e-6) AS rest,
    sum(n) OVER (PARTITION BY o.source ORDER BY {deal}, block, draw, id) AS run,
    rank() OVER (PARTITION BY o.source ORDER BY {deal}, block, draw, id) - 1 AS position
  FROM o JOIN w USING (source))
SELECT id AS doc_id, source, n AS n_tokens, round(weight, 9) AS weight, (passes + (run <= rest)::INT)::BIGINT AS copies, block::BIGINT AS block, position FROM r"""


def _bisected(too_flat: str) -> str:
    """The exponent between 0 and 1 at which a condition on mid, over one row of m, stops to hold."""
    return f""", b AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
    SELECT i + 1, CASE WHEN f THEN mid ELSE low END, CASE WHEN f THEN high ELSE mid END FROM (SELECT b.*, (low + high) / 2 AS mid, {too_flat} AS f FROM b, m) WHERE i < 60)"""


#: The repetition limit with the smallest full budget has a closed form: (largest / smallest)^(1 - x) = limit.
SQL = _sql(f"CASE WHEN most = least THEN 1 ELSE greatest(0, 1 - ln({REPEAT}) / ln(most / least)) END", "most / pow(most / total, x) * norm")
_MID = "(low + high) / 2"
_SUM = f"(SELECT sum(pow(t / m.total, {_MID})) FROM s)"
_LOGS = f"(SELECT sum(pow(t / m.total, {_MID}) * ln(t / m.total)) FROM s)"
#: An entropy, and a budget of tokens under a repetition limit.
ENTROPY, BUDGET = 0.9, 150_000.0
ENTROPY_SQL = _sql("(SELECT high FROM b WHERE i = 60)", "most / pow(most / total, x) * norm", _bisected(f"ln({_SUM}) - {_MID} * {_LOGS} / {_SUM} > {ENTROPY} * ln(k)"))
BUDGET_SQL = _sql(
    "(SELECT high FROM b WHERE i = 60)", f"{BUDGET}", _bisected(f"({_MID} - 1) * ln(least / total) + ln({BUDGET} / total) - ln({_SUM}) > ln({REPEAT})")
)
