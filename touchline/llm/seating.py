"""Table counts of Pitman-Yor restaurants, drawn for many dishes at once."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .textvec import mix

#: Dishes up to this size have the weights of all their table counts in a table.
EXACT = 512
#: Tables up to which a finite sum is used; Metropolis steps.
FEW, STEPS = 40, 5
#: Sizes up to which dishes are drawn together (64 ends the small table of ``log_ways``), and weights that are held at a time.
_SIZES = np.unique(np.r_[np.arange(2, 11), 64, np.minimum(np.rint(10 * 1.1 ** np.arange(1, 43)), EXACT)]).astype(np.int64)
_CELLS = 1 << 17
#: ``[t, j]``: ways to choose ``j`` of ``t``.
_CHOOSE = np.array([[math.comb(t, j) for j in range(FEW + 1)] for t in range(FEW + 1)], np.float64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, elementwise, for positive numbers."""
    small = np.ones_like(x)
    for k in range(8):
        small = small * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(small)


@lru_cache(maxsize=8)
def log_ways(most: int, d: float) -> np.ndarray:
    """``[n, t]``: log weight of all seatings of ``n`` customers at ``t`` tables of one dish."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, most):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - d * t)
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n + 1, 1 : n + 2], out[n, 0 : n + 1])
    return out


def log_ways_of_many(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """``log_ways`` for ``n`` above ``EXACT``: few tables by their finite sum, more by a saddle point (error about 1 / (12 t))."""
    n, t, out = n.astype(np.float64), t.astype(np.float64), np.zeros(len(n))
    few = (t <= FEW) & (t <= np.maximum(3 * n**d, 4)) & (t <= n / 2)
    if few.any():
        m, k = n[few], t[few]
        whole, tables = log_gamma(m), k.astype(np.int64)
        j = np.arange(1, int(tables.max()) + 1)[:, None]
        sign = np.array([(-1) ** (i + 1) * math.sin(math.pi * i * d) / math.pi for i in j[:, 0].tolist()])[:, None]
        own = np.array([math.lgamma(1 + i * d) for i in j[:, 0].tolist()])[:, None]
        total = (_CHOOSE.T[1 : len(j) + 1, tables] * sign * np.exp(log_gamma(np.maximum(m - j * d, 0.1)) + own - whole)).sum(axis=0)
        out[few] = whole + np.log(np.maximum(total, 1e-300)) - k * math.log(d) - log_gamma(k + 1)
    if not few.all():
        m, k = n[~few], t[~few]
        with np.errstate(all="ignore"):
            goal = np.log(m / k)
            v = (goal - math.log(d)) / (1 - d)
            for _ in range(8):
                slope = 1 / -np.expm1(-v) - d / -np.expm1(-d * v)
                v = np.maximum(v - (v - d * v + np.log(-np.expm1(-v)) - np.log(-np.expm1(-d * v)) + math.log(d) - goal) / slope, 1e-9)
            slope = 1 / -np.expm1(-v) - d / -np.expm1(-d * v)
            here = log_gamma(m + 1) - log_gamma(k + 1) + k * np.log(-np.expm1(-d * v) / d) - m * np.log(-np.expm1(-v)) - 0.5 * np.log(2 * math.pi * m * np.expm1(v) * slope)
        out[~few] = np.where(k == m, 0.0, here)
    return out


def uniforms(key: np.ndarray, number: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the draw's number alone, wherever a dish is worked on."""
    return ((mix(key.view(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _add_up(x: np.ndarray) -> None:
    """Running sums down the columns, in place."""
    if len(x) > 16:
        np.cumsum(x, axis=0, out=x)
        return
    for j in range(1, len(x)):
        np.add(x[j], x[j - 1], out=x[j])


def draw_tables(n: np.ndarray, rest: np.ndarray, p: np.ndarray, d: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Table counts of dishes whose ``n`` customers all sit down anew.

    ``rest`` is strength + discount * tables of the restaurant's other dishes, ``p`` the
    dish's probability in the parent. ``t`` tables weigh their number of seatings times
    ``(rest + i * d) * p`` for each table; the weights rise to one peak and fall. Above
    ``EXACT`` customers ``STEPS`` Metropolis steps with a proposal at the peak draw from them.
    ``key`` and ``sweep`` fix the random numbers, so that a repeated task, or another
    layout of the data, draws the same.
    """
    number = sweep * (3 * STEPS + 1)
    out = np.minimum(n, 1).astype(np.int64)
    small = np.flatnonzero((n >= 2) & (n <= EXACT))
    if len(small):
        ways = log_ways(EXACT if int(n[small].max()) > 64 else 64, d)
        order = small[np.argsort(n[small].astype(np.uint16), kind="stable")]
        # Dishes of nearly the same size go together; seatings at more tables than customers weigh nothing.
        size = np.searchsorted(_SIZES, n[order])
        which, first = np.unique(size, return_index=True)
        for k, s, e in zip(_SIZES[which].tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            for a in range(s, e, max(1, _CELLS // k)):
                i = order[a : min(e, a + max(1, _CELLS // k))]
                weight = np.log((rest[i] + (d * np.arange(k))[:, None]) * p[i])
                _add_up(weight)
                weight += ways[n[i], 1 : k + 1].T
                weight -= weight.max(axis=0)
                np.exp(weight, out=weight)
                _add_up(weight)
                out[i] = 1 + (weight[:-1] < uniforms(key[i], number) * weight[-1]).sum(axis=0)
    large = np.flatnonzero(n > EXACT)
    for a in range(0, len(large), 1000):
        i = large[a : a + 1000]
        of_table, seats = np.log(p[i]) + math.log(d), rest[i] / d
        taken = log_gamma(seats)

        def weight(*t):
            """The weights of several counts of each dish, at once: what calls cost is most of it, as large dishes are few."""
            many, t = len(t), np.concatenate(t)
            ways = log_ways_of_many(np.tile(n[i], many), t, d)
            return np.split(ways + t * np.tile(of_table, many) + log_gamma(np.tile(seats, many) + t) - np.tile(taken, many), many)

        low, high = np.ones(len(i), np.int64), n[i].astype(np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, n[i] - 1)
            more, here = weight(middle + 1, middle)
            up = more > here
            low, high = np.where(up & (low < high), middle + 1, low), np.where(up, high, np.maximum(middle, low))
        # The peak's curvature gives a normal proposal; steps are accepted by the weights.
        peak = low
        side = np.clip(np.stack([peak - 1, peak, peak + 1]), 1, n[i])
        left, here, right = weight(*side)
        bend = np.where((side[0] < peak) & (side[2] > peak), 2 * here - left - right, 1 / (peak + 1.0))
        spread = 1.1 / np.sqrt(np.maximum(bend, 1 / (peak + 1.0))) + 0.5
        t, log_t = peak, here
        drawn = [[uniforms(key[i], number + 1 + 3 * step + j) for j in range(3)] for step in range(STEPS)]
        tried = [np.rint(peak + spread * np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)).astype(np.int64) for u, v, _ in drawn]
        kept = [np.clip(new, 1, n[i]) for new in tried]
        for new, asked, log_new, (_, _, w) in zip(kept, tried, weight(*kept), drawn, strict=True):
            gain = log_new - log_t + ((new - peak) ** 2 - (t - peak) ** 2) / (2 * spread**2)
            take = (new == asked) & (np.log(w) < gain)
            t, log_t = np.where(take, new, t), np.where(take, log_new, log_t)
        out[i] = t
    return out
