"""Exact quantiles of whole columns without sorting or shuffling the data.

Round one reads the columns once and brackets every wanted rank between two
values of a mergeable sketch. Round two counts, by plain aggregates, how many
rows lie below, on and between the bracket ends, and picks the wanted ranks
among the rows between. Should more rows lie between than one aggregate buffer
may hold, or should a bracket miss its rank, the bracket moves and round two is
repeated. Interpolation is linear at (n - 1) * p.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.functions.columns import number

SKETCH_ACCURACY = 10000
BRACKET = 2e-4
MAX_BETWEEN, LEAST_BETWEEN = 200_000, 1000
#: Targets that may use all of MAX_BETWEEN each; more of them share as much room.
SHARED = 12
FEW_ROWS = 20_000
MAX_ROUNDS = 50


@dataclass
class _Target:
    """One wanted quantile: its bracket [low, high] and what is known of the rows inside."""

    column: str
    p: float
    n: int
    outer: tuple[float, float]
    low: float
    high: float
    bracket: float = BRACKET
    most_between: float = 0
    limit: int = 0
    below: int = 0
    on_low: int = 0
    between: int = 0
    result: float | None = None

    @property
    def ranks(self) -> tuple[int, int]:
        place = (self.n - 1) * self.p
        return math.floor(place), math.ceil(place)

    @property
    def fits(self) -> bool:
        return self.most_between <= self.limit

    def expect(self, rows: int) -> None:
        """Twice the sketch's error bound: no more rows than this lie between the ends."""
        self.most_between = min(rows, 4 * rows * (self.bracket + 1 / SKETCH_ACCURACY))

    def widen(self) -> None:
        """Start from all rows, with more room around the rank."""
        self.low, self.high = self.outer
        self.most_between = self.n
        self.bracket = min(0.1, self.bracket * 10)

    def interpolate(self, first: float, second: float) -> None:
        weight = (self.n - 1) * self.p - self.ranks[0]
        self.result = first + (second - first) * weight if weight else first


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Iterable[float]
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of every column; an empty column gives None."""
    probabilities = list(probabilities)
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    data = df.select(*[number(df, c).alias(v) for c, v in names.items()])

    ends = sorted({min(1.0, max(0.0, p + s)) for p in probabilities for s in (-BRACKET, BRACKET)})
    aggregates = []
    for i, v in enumerate(names.values()):
        aggregates += [
            f"count({v}) AS n{i}",
            f"min({v}) AS min{i}",
            f"max({v}) AS max{i}",
            f"percentile_approx({v}, {_array(ends)}, {SKETCH_ACCURACY}) AS q{i}",
        ]
    sketch = _row(data, aggregates)

    targets: list[_Target] = []
    for i, c in enumerate(columns):
        n = sketch[f"n{i}"]
        if not n:
            continue
        outer = (sketch[f"min{i}"], sketch[f"max{i}"])
        at = dict(zip(ends, sketch[f"q{i}"], strict=True))
        for p in probabilities:
            low = at[max(0.0, p - BRACKET)] if p > BRACKET else outer[0]
            high = at[min(1.0, p + BRACKET)] if p < 1 - BRACKET else outer[1]
            target = _Target(c, p, n, outer, low, high)
            if n > FEW_ROWS:
                target.expect(n)
            else:
                target.widen()
            targets.append(target)

    # the values between the ends of all brackets meet in one aggregate buffer: the targets share its room
    for t in targets:
        t.limit = max(min(MAX_BETWEEN, LEAST_BETWEEN), MAX_BETWEEN * SHARED // max(SHARED, len(targets)))
    for _ in range(MAX_ROUNDS):
        pending = [t for t in targets if t.result is None]
        if not pending:
            break
        _count(data, names, pending)
        _narrow(data, names, [t for t in pending if t.result is None and t.between > t.limit])
    else:
        raise RuntimeError("the quantile search did not settle")

    found = {(t.column, t.p): t.result for t in targets}
    return {c: {p: found.get((c, p)) for p in probabilities} for c in columns}


def _row(data: DataFrame, aggregates: list[str]) -> Row:
    return data.agg(*[F.expr(a) for a in aggregates]).first()


def _number(value: float) -> str:
    return f"double('{value!r}')"


def _array(values: Sequence[float]) -> str:
    return f"array({', '.join(map(_number, values))})"


def _count(data: DataFrame, names: dict[str, str], targets: list[_Target]) -> None:
    aggregates = []
    for i, t in enumerate(targets):
        v, low, high = names[t.column], _number(t.low), _number(t.high)
        below, on_low, inner = f"count_if({v} < {low})", f"count_if({v} = {low})", f"{v} > {low} AND {v} < {high}"
        aggregates += [f"{below} AS below{i}", f"{on_low} AS low{i}"]
        if t.high > t.low:
            aggregates += [f"count_if({inner}) AS between{i}", f"count_if({v} = {high}) AS high{i}"]
            if t.fits:
                held = f"array_sort(collect_list(CASE WHEN {inner} THEN {v} END))"
                aggregates += [
                    f"get({held}, int({rank} - {below} - {on_low})) AS pick{i}_{j}" for j, rank in enumerate(t.ranks)
                ]
    row = _row(data, aggregates)
    for i, t in enumerate(targets):
        _settle(t, row, i)


def _settle(t: _Target, row: Row, i: int) -> None:
    t.below, t.on_low = row[f"below{i}"], row[f"low{i}"]
    t.between, on_high = (row[f"between{i}"], row[f"high{i}"]) if t.high > t.low else (0, 0)
    first, second = t.ranks
    inner_start, inner_end = t.below + t.on_low, t.below + t.on_low + t.between
    if first < t.below or second >= inner_end + on_high:
        t.widen()
        t.between = 0
        return
    picked = []
    for j, rank in enumerate((first, second)):
        if rank < inner_start:
            picked.append(t.low)
        elif rank >= inner_end:
            picked.append(t.high)
        else:
            picked.append(row[f"pick{i}_{j}"] if t.fits else None)
    if None in picked:
        t.most_between = t.between
    else:
        t.interpolate(*picked)


def _narrow(data: DataFrame, names: dict[str, str], targets: list[_Target]) -> None:
    """Bring the bracket ends closer, by a sketch of only the rows inside."""
    if not targets:
        return
    aggregates = []
    for i, t in enumerate(targets):
        v, low, high = names[t.column], _number(t.low), _number(t.high)
        start = t.below + t.on_low
        wanted = [(rank - start) / max(1, t.between - 1) for rank in t.ranks]
        ends = [min(1.0, max(0.0, wanted[0] - t.bracket)), min(1.0, max(0.0, wanted[1] + t.bracket))]
        inner = f"CASE WHEN {v} > {low} AND {v} < {high} THEN {v} END"
        aggregates.append(f"percentile_approx({inner}, {_array(ends)}, {SKETCH_ACCURACY}) AS q{i}")
    row = _row(data, aggregates)
    for i, t in enumerate(targets):
        first, second = t.ranks
        start, rows, ends = t.below + t.on_low, t.between, row[f"q{i}"]
        if first >= start:
            t.low = ends[0]
        if second < start + rows:
            t.high = ends[1]
        t.expect(rows)
