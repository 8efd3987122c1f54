"""Tail probabilities for test statistics.

Used on one aggregated row after the Spark work is done.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

TINY = 1e-300


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c = 1 / TINY
    d = 1 / b
    h = d
    for i in range(1, 100000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or TINY)
        c = b + step / c or TINY
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c = 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 100000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        last = 1.0
        for step in (even, odd):
            d = 1 / (1 + step * d or TINY)
            c = 1 + step / c or TINY
            last = c * d
            h *= last
        if abs(last - 1) < 1e-16:
            break
    return h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_tail(x: float, dof: float) -> float:
    return _gamma_upper(dof / 2, x / 2)


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, top: float, bottom: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_lower(bottom / 2, top / 2, bottom / (bottom + top * f))


def kolmogorov_two_sided(d: float, n: int) -> float:
    """P(D_n >= d): Marsaglia, Tsang and Wang (2003), the limit law for large n."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    s = d * d * n
    if s > 7.24 or (s > 3.76 and n > 99):
        return min(1.0, 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s))
    if n > 10000:
        total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * s) for k in range(1, 101))
        return min(1.0, max(0.0, 2 * total))
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    matrix = np.tril(np.ones((m, m)), 1)
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[m - 1, :] -= powers[::-1]
    matrix[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    rows, columns = np.indices((m, m))
    distance = rows - columns + 1
    for i in range(2, m + 1):
        matrix[distance >= i] /= i
    power, scale = _matrix_power(matrix, n)
    value = power[k - 1, k - 1]
    log_value = math.log(value) + scale + math.lgamma(n + 1) - n * math.log(n) if value > 0 else -math.inf
    return min(1.0, max(0.0, 1 - math.exp(log_value)))


def _matrix_power(matrix: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Matrix power with the logarithm of a running scale factor."""
    result, log_result = np.eye(len(matrix)), 0.0
    base, log_base = matrix, 0.0
    while n:
        if n & 1:
            result, log_result = result @ base, log_result + log_base
        base, log_base = base @ base, 2 * log_base
        top = base.max()
        base, log_base = base / top, log_base + math.log(top)
        top = result.max()
        result, log_result = result / top, log_result + math.log(top)
        n >>= 1
    return result, log_result


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the Mann-Whitney U without ties."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for i in range(1, min(n1, n2) + 1):
        # multiply by (1 - q^(longer + i)) / (1 - q^i), one Gaussian binomial factor
        shift = max(n1, n2) + i
        if shift < len(ways):
            ways[shift:] -= ways[:-shift].copy()
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    high = int(max(u, n1 * n2 - u))
    return float(min(1.0, 2 * ways[high:].sum() / ways.sum()))


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of the Wilcoxon signed-rank statistic without ties or zeros."""
    top = n * (n + 1) // 2
    ways = np.zeros(top + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


STANDARD_NORMAL = NormalDist()
