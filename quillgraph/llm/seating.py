"""Tables of Pitman-Yor restaurants, sampled with the sizes of tables summed out.

The customers of one dish sit at some number of tables. Given all other tables, that number has a distribution that the
generalised Stirling numbers give in closed form: a Gibbs step unseats all customers of the dish, and draws the tables at
which they sit anew from it. Up to EXACT customers the numbers come from their recursion; beyond, from the saddle point of
their generating function, corrected by what it misses at EXACT. Steps of one class of customers are drawn at once, against
the restaurant's tables as they then are.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

EXACT = 512
#: Points at which a distribution over very many tables is read.
POINTS = 257


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x: Stirling's series ten places on."""
    x = np.asarray(x, np.float64)
    p = np.ones_like(x)
    for k in range(10):
        p = p * (x + k)
    y = x + 10
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


@lru_cache(8)
def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of discount d: row customers, column tables, up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
        stay[~np.isfinite(stay)] = -np.inf
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
        out[c + 1, 0] = -np.inf
    return out


@lru_cache(8)
def correction(d: float) -> np.ndarray:
    """By how much the saddle point errs at EXACT customers and 1, 2, ... tables; with very many it does not."""
    t = np.arange(1, EXACT + 1)
    return np.where(t < EXACT // 2, stirling(d)[EXACT, 1:] - saddle(np.full(EXACT, EXACT), t, d), 0.0)


def numbers(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for any c over EXACT and 1 <= t <= c. What the saddle point misses hangs on t / c**d alone, so it is read off at
    EXACT customers; where t is less than one table there, the numbers have a limit of their own."""
    c, t = np.broadcast_arrays(np.asarray(c, np.float64), np.asarray(t, np.float64))
    like = t * (EXACT / c) ** d
    out = saddle(c, t, d) + np.interp(np.log(np.maximum(like, 1)), np.log(np.arange(1, EXACT + 1)), correction(d))
    few = lgamma(c) - lgamma(t) - (t - 1) * math.log(d) - lgamma(np.array(1 - d)) - d * np.log(c)
    return np.where(like < 1, few, out)


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Their saddle point approximation."""
    c, t = np.broadcast_arrays(np.asarray(c, np.float64), np.asarray(t, np.float64))
    inner = np.clip(t, 1, np.maximum(c - 0.5, 1))
    want = np.log(c / inner)
    lo, hi = np.full(c.shape, -600.0), np.full(c.shape, -1e-12)  # y, the logarithm of 1 - x

    def ratio(y: np.ndarray) -> np.ndarray:
        return np.log(-np.expm1(y)) + (d - 1) * y - np.log(-np.expm1(d * y) / d)

    for _ in range(60):
        y = (lo + hi) / 2
        high = ratio(y) > want
        lo, hi = np.where(high, y, lo), np.where(high, hi, y)
    y = (lo + hi) / 2
    x, g, rho = -np.expm1(y), -np.expm1(d * y) / d, np.exp(ratio(y))
    spread = np.maximum(inner * rho * (1 + (1 - d) * x * np.exp(-y) - rho), 1e-9)
    return lgamma(c + 1) - lgamma(inner + 1) + inner * np.log(g) - c * np.log(x) - 0.5 * np.log(2 * math.pi * spread)


def rise(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Logarithm of v (v + 1) ... (v + t - 1), without the loss of digits that a difference of large logarithms has."""
    big = np.maximum(v, 1e3)
    far = (big - 0.5) * np.log1p(t / big) + t * np.log(big + t) - t + (1 / (big + t) - 1 / big) / 12
    return np.where(v > 1e3, far, lgamma(np.minimum(v, 1e3) + t) - lgamma(np.minimum(v, 1e3)))


def drawn(c: np.ndarray, rest: np.ndarray, a: np.ndarray, e: np.ndarray | None, d: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables at which c > 1 customers of each dish sit. rest: the restaurant's other tables; the parent gives the dish
    (a + j) / (e + j) when j customers have been sent to it, or a always if e is None. c is the same for all, up to EXACT, or
    larger throughout."""
    if c[0] <= EXACT:
        k, out = int(c[0]), np.empty(len(c), np.int64)
        at = stirling(d)[k, 1 : k + 1]
        j = np.arange(k)
        step = max(1, 1_000_000 // k)
        for i in range(0, len(c), step):
            s = slice(i, i + step)
            w = np.log((strength + d * (rest[s, None] + j)) * (a[s, None] if e is None else (a[s, None] + j) / (e[s, None] + j)))
            w = np.cumsum(w, axis=1) + at
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[s] = 1 + (w < rng.random((len(w), 1)) * w[:, -1:]).sum(axis=1)
        return np.minimum(out, k)

    def weight(t: np.ndarray) -> np.ndarray:
        col = lambda v: np.asarray(v, np.float64)[:, None]
        sent = t * np.log(col(a)) if e is None else rise(col(a), t) - rise(col(e), t)
        return numbers(col(c), t, d) + t * math.log(d) + rise(strength / d + col(rest), t) + sent

    lo, hi = np.ones(len(c)), c.astype(np.float64)
    for _ in range(40):  # the mode, between ever closer points
        t = np.round(lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 9))
        best = weight(t).argmax(axis=1)
        row = np.arange(len(c))
        lo, hi = t[row, np.maximum(best - 1, 0)], t[row, np.minimum(best + 1, 8)]
        if (hi - lo <= 4).all():
            break
    mode = np.round((lo + hi) / 2)
    top, half = weight(mode[:, None])[:, 0], np.full(len(c), 8.0)
    for _ in range(60):
        ends = np.stack([np.maximum(mode - half, 1), np.minimum(mode + half, c)], axis=1)
        free = np.stack([mode - half > 1, mode + half < c], axis=1)
        wide = ((weight(ends) > top[:, None] - 30) & free).any(axis=1)
        if not wide.any():
            break
        half = np.where(wide, half * 2, half)
    lo, hi = np.maximum(mode - half, 1), np.minimum(mode + half, c)
    width = np.ceil((hi - lo + 1) / POINTS)
    t = lo[:, None] + width[:, None] * np.arange(POINTS)
    inside = t <= hi[:, None]
    w = np.where(inside, weight(np.minimum(t, c[:, None])), -np.inf)
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    cell = (w < rng.random((len(w), 1)) * w[:, -1:]).sum(axis=1)
    got = t[np.arange(len(c)), np.minimum(cell, POINTS - 1)] + np.floor(rng.random(len(c)) * width)
    return np.clip(got, 1, hi).astype(np.int64)


def sweep(c: np.ndarray, t: np.ndarray, room: np.ndarray, tables: np.ndarray, parent, d: float, strength: float, rng: np.random.Generator) -> None:
    """One Gibbs sweep, in place: t of each dish, and tables of each restaurant (room: which one a dish is in). parent(i) gives
    a and e of dishes i, their own tables taken out. Dishes of one customer keep their one table."""
    order = np.flatnonzero(c > 1)
    order = order[np.argsort(np.minimum(c[order], EXACT + 1), kind="stable")]
    kinds = np.minimum(c[order], EXACT + 1)
    bounds = np.flatnonzero(np.diff(kinds)) + 1
    for i in np.split(order, bounds):
        if len(i):
            a, e = parent(i)
            new = drawn(c[i], tables[room[i]] - t[i], a, e, d, strength, rng)
            np.add.at(tables, room[i], new - t[i])
            t[i] = new


def likelihood(c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, d: float, strength: float) -> float:
    """Logarithm of the chance of the seating: c, t of dishes; customers, tables of restaurants that have any."""

    def total(v: np.ndarray, f) -> float:
        x, n = np.unique(v, return_counts=True)
        return float((f(x.astype(np.float64)) * n).sum()) if len(x) else 0.0

    out = total(tables, lambda x: x * math.log(d) + lgamma(strength / d + x) - lgamma(np.array(strength / d)))
    out -= total(customers, lambda x: lgamma(strength + x) - lgamma(np.array(strength)))
    small = c <= EXACT
    x, n = np.unique(c[small] * (EXACT + 1) + t[small], return_counts=True)
    out += float((stirling(d)[x // (EXACT + 1), x % (EXACT + 1)] * n).sum())
    return out + (float(numbers(c[~small], t[~small], d).sum()) if (~small).any() else 0.0)


def grid(d: float, strength: float) -> list[tuple[float, float]]:
    """Discounts and strengths near the current ones, among which a Gibbs step chooses."""
    ds = sorted({round(min(0.97, max(0.02, d + x)), 3) for x in (-0.06, -0.02, 0.0, 0.02, 0.06)})
    return [(x, round(strength * f, 6)) for x in ds for f in (0.5, 0.8, 1.0, 1.25, 2.0)]


def chosen(points: list[tuple[float, float]], logs: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """One of the points by their chances."""
    return points[int(np.argmax(np.round(logs, 6) + rng.gumbel(size=len(points))))]
