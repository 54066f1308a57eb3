"""Tail probabilities of the paired tests, from sufficient statistics."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon_exact_sf(n: int, w_plus: float) -> float:
    """P(W+ >= w) for n untied differences: subsets of the ranks by their sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return sum(ways[math.ceil(w_plus - 1e-9) :]) / 2**n


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T >= t)."""
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def sign_test(wins: int, losses: int) -> float | None:
    """Two-sided binomial test of equal chances, exact below 20,000 wins and losses, else by the normal approximation, which then differs in the fourth digit; null without any."""
    n, k = wins + losses, min(wins, losses)
    if n == 0:
        return None
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)) if n < 20_000 else normal_sf((n - 2 * k - 1) / math.sqrt(n))
    return min(1.0, 2 * tail)


def all_tests(r) -> list[tuple]:
    """test, alternative, statistic, p of one row of n, ties, w_plus, w_minus, z, t, pairs, wins, losses; missing statistics have no p."""
    known = lambda x: x is not None and x == x
    if 0 < r.n <= 50 and r.ties == 0:
        up, down = wilcoxon_exact_sf(r.n, r.w_plus), wilcoxon_exact_sf(r.n, r.w_minus)
    else:
        up, down = (normal_sf(r.z), normal_sf(-r.z)) if known(r.z) else (None, None)
    p = t_sf(r.t, r.pairs - 1) if known(r.t) else None
    return [
        ("wilcoxon", "greater", r.w_plus, up), ("wilcoxon", "two-sided", min(r.w_plus, r.w_minus), None if up is None else min(1.0, 2 * min(up, down))),
        ("paired t", "greater", r.t, p), ("paired t", "two-sided", r.t, None if p is None else 2 * min(p, 1 - p)), ("sign", "two-sided", float(r.wins), sign_test(r.wins, r.losses)),
    ]
