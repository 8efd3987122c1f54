"""SQL texts of formulas that SQL has no function for."""

from __future__ import annotations

from millrace.functions import normal as N


def polynomial(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def normal_cdf(z: str) -> str:
    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2) * {polynomial(N.HART_TOP, a)} / {polynomial(N.HART_BOTTOM, a)}"
    fraction = f"({a} + 0.65)"
    for step in (4, 3, 2, 1):
        fraction = f"({a} + {step} / {fraction})"
    far = f"exp(-{a} * {a} / 2) / {fraction} / {N.ROOT_TWO_PI}"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {N.HART_SWITCH} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_ppf(p: str) -> str:
    r = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    centre = f"({p} - 0.5) * {polynomial(N.WICHURA_CENTRE_TOP, r)} / {polynomial(N.WICHURA_CENTRE_BOTTOM, r)}"
    s = f"sqrt(-ln(least({p}, 1 - {p})))"
    middle = f"{polynomial(N.WICHURA_MIDDLE_TOP, f'({s} - 1.6)')} / {polynomial(N.WICHURA_MIDDLE_BOTTOM, f'({s} - 1.6)')}"
    tail = f"{polynomial(N.WICHURA_TAIL_TOP, f'({s} - 5.0)')} / {polynomial(N.WICHURA_TAIL_BOTTOM, f'({s} - 5.0)')}"
    side = f"(CASE WHEN {s} <= 5.0 THEN {middle} ELSE {tail} END) * (CASE WHEN {p} < 0.5 THEN -1.0 ELSE 1.0 END)"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} ELSE {side} END)"


def power_fit(source: str, key: str, column: str, kind: str, digits: int) -> str:
    """The power transformation fitted by the same bracket search, written as nested grids."""
    if kind == "boxcox":
        seen = "ln(x) - (SELECT avg(ln(x)) FROM v)"
        curve = lambda y, p: f"CASE WHEN abs({p}) < 1e-12 THEN {y} ELSE (exp({p} * {y}) - 1) / {p} END"
        score = "-(SELECT count(*) FROM v) / 2.0 * ln(var_pop(f)) - (SELECT count(*) * avg(ln(x)) FROM v)"
        final = lambda p: curve("ln(x)", p)
    else:
        seen = "x"

        def curve(y: str, p: str) -> str:
            logs = f"ln(1 + abs({y}))"
            up = f"CASE WHEN abs({p}) < 1e-12 THEN {logs} ELSE (exp({p} * {logs}) - 1) / {p} END"
            down = f"CASE WHEN abs(2 - {p}) < 1e-12 THEN {logs} ELSE (exp((2 - {p}) * {logs}) - 1) / (2 - {p}) END"
            return f"CASE WHEN {y} >= 0 THEN {up} ELSE -({down}) END"

        score = "-(SELECT count(*) FROM v) / 2.0 * ln(var_pop(f)) + (p - 1) * (SELECT sum(sign(x) * ln(1 + abs(x))) FROM v)"
        final = lambda p: curve("x", p)
    parts = [
        f"v AS MATERIALIZED (SELECT {column} AS x FROM {source} WHERE {column} IS NOT NULL)",
        f"y AS MATERIALIZED (SELECT {seen} AS y FROM v)",
        "g1 AS (SELECT i, -2.0::DOUBLE + i * 0.125 AS p FROM range(33) t(i))",
    ]
    width = 4.0
    for k in (1, 2, 3):
        step = width / 32
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT i, p, {score} AS ll FROM (SELECT g{k}.i, g{k}.p, {curve('y.y', f'g{k}.p')} AS f "
            f"FROM g{k}, y) GROUP BY i, p)"
        )
        if k < 3:
            width = 2 * step
            parts.append(
                f"g{k + 1} AS (SELECT t.i, b.p - {step}::DOUBLE + t.i * {width / 32}::DOUBLE AS p "
                f"FROM (SELECT arg_max(p, ll) AS p FROM s{k}) b, range(33) t(i))"
            )
    step = width / 32
    parts.append(
        f"near AS (SELECT i, p, ll, lag(ll) OVER (ORDER BY i) AS a, lead(ll) OVER (ORDER BY i) AS c FROM s3)"
    )
    parts.append(
        f"best AS MATERIALIZED (SELECT p + 0.5 * {step}::DOUBLE * (a - c) / (a - 2 * ll + c) AS p FROM near ORDER BY ll DESC LIMIT 1)"
    )
    parts.append(f"out AS MATERIALIZED (SELECT {key}, {column} AS x0, CASE WHEN x IS NOT NULL THEN {final('(SELECT p FROM best)')} END AS f "
                 f"FROM (SELECT {key}, {column}, {column} AS x FROM {source}))")
    return (
        f"WITH {', '.join(parts)} SELECT {key}, round((f - (SELECT avg(f) FROM out)) / (SELECT stddev_pop(f) FROM out), {digits}) + 0.0 "
        f"AS {column} FROM out"
    )
