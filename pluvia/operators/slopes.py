"""Statistics over all pairs of a series in O(n log n), in numpy: the median slope, and Mann-Kendall's S.

A pair's slope is below m just if the pair is inverted in the order of y - m t, so that slopes below m are counted by
merging, without forming pairs. Random pairs bracket the median, inversions confirm the bracket and name its pairs,
until few enough are left to be formed and sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


#: Divisions at one slope after which slopes count as equal.
ROUNDS = 40


def inversions(ranks: np.ndarray, picks: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(how many pairs of a permutation are inverted, and of those numbered by `picks`, sorted, the earlier and the later places).

    Blocks are merged level by level, all at once: an element of a right block is inverted with the larger ones of its left block.
    """
    n = len(ranks)
    values, places = ranks.astype(np.int64), np.arange(n)
    total, width, later, earlier = 0, 1, [], []
    at = np.arange(n)
    while width < n:
        block = at // (2 * width)
        key = block * n + values
        left = (at // width) % 2 == 0
        sorted_left, right = key[left], np.flatnonzero(~left)
        first = np.searchsorted(sorted_left, key[right])
        many = np.searchsorted(sorted_left, (block[right] + 1) * n) - first
        ends = np.cumsum(many)
        here = int(ends[-1]) if len(ends) else 0
        if picks is not None and here:
            a, b = np.searchsorted(picks, (total, total + here))
            wanted = picks[a:b] - total
            r = np.searchsorted(ends, wanted, "right")
            l = first[r] + wanted - (ends[r] - many[r])  # noqa: E741
            earlier.append(places[np.flatnonzero(left)[l]])
            later.append(places[right[r]])
        total += here
        order = np.argsort(key, kind="stable")
        values, places = values[order], places[order]
        width *= 2
    none = np.zeros(0, np.int64)
    return total, np.concatenate(earlier or [none]), np.concatenate(later or [none])


def _order(t: np.ndarray, y: np.ndarray, m: float) -> np.ndarray:
    """Places by y - m t; of equal ones, and so of the same t, in the order of t and y."""
    return np.lexsort((y, t, y - m * t))


def _inverted(first: np.ndarray, second: np.ndarray, picks: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Pairs of places that two orders put differently."""
    ranks = np.empty(len(first), np.int64)
    ranks[second] = np.arange(len(first))
    n, i, j = inversions(ranks[first], picks)
    return n, first[i], first[j]


def pair_count(t: np.ndarray) -> int:
    """Pairs of places with different t."""
    n, (_, same) = len(t), np.unique(t, return_counts=True)
    return n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())


def _side(k: int, low: float, high: float, before: int, upto: int, a: float, b: float, below: Callable[[float], int]) -> tuple[float, float, int, int]:
    """Which of the brackets (low, a), (a, b), (b, high) has the slope at rank k, with the ranks that it has."""
    n_a, n_b = below(a), below(b)
    if k < n_a:
        return low, a, before, n_a
    return (a, b, n_a, n_b) if k < n_b else (b, high, n_b, upto)


def median_slope(t: np.ndarray, y: np.ndarray, seed: int = 3, enough: int | None = None) -> float | None:
    """The median of (y_j - y_i) / (t_j - t_i) over all pairs with different t; None without one.

    enough: pairs that are formed at once.
    """
    pairs, n = pair_count(t), len(t)
    if not pairs:
        return None
    enough = enough or max(8 * n, 1 << 14)

    def slopes(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = i[t[i] != t[j]], j[t[i] != t[j]]
        return (y[j] - y[i]) / (t[j] - t[i])

    lower, upper = (pairs - 1) // 2, pairs // 2
    if pairs <= enough:
        s = np.sort(slopes(*np.triu_indices(n, 1)))
        return float((s[lower] + s[upper]) / 2)
    rng = np.random.default_rng(seed)
    u, v = t - np.median(t), y - np.median(y)  # smaller numbers, the same slopes
    by_t = np.lexsort((v, u))
    # the extreme slopes lie between neighbouring times
    times, start = np.unique(u[by_t], return_index=True)
    lows, highs, gaps = np.minimum.reduceat(v[by_t], start), np.maximum.reduceat(v[by_t], start), np.diff(times)
    least, most = float(((lows[1:] - highs[:-1]) / gaps).min()), float(((highs[1:] - lows[:-1]) / gaps).max())
    step = 8 * np.finfo(float).eps / float(gaps.min())  # by which lines must differ for their orders to be told apart
    margin = lambda m: step * (float(np.ptp(v)) + abs(m) * float(np.ptp(u)))
    below = lambda m: _inverted(by_t, _order(u, v, m))[0]

    def at(k: int) -> tuple[float, float | None]:
        """The slopes at ranks k and k + 1, from 0; the latter only if it comes for nothing."""
        low, high, before, upto = least - margin(least), most + margin(most), 0, pairs
        seen, rounds = None, 0
        s = slopes(rng.integers(0, n, enough), rng.integers(0, n, enough))
        while True:
            s = np.sort(s)
            share, spread = (k - before) / (upto - before) * len(s), 3 * np.sqrt(len(s)) + 2
            a, b = s[max(0, int(share - spread))], s[min(len(s) - 1, int(share + spread))]
            new_low, new_high = max(low, float(a - margin(a))), min(high, float(b + margin(b)))
            n_low, n_high = below(new_low), below(new_high)
            if n_low <= k < n_high and n_high - n_low < 0.9 * (upto - before):
                low, high, before, upto = new_low, new_high, n_low, n_high
            else:  # not there, or a run of equal slopes: one of them divides the rest
                m, rounds = float(s[min(int(share), len(s) - 1)]), rounds + 1
                if m == seen or rounds > ROUNDS:  # beyond what lines can tell apart
                    return m, None
                seen = m
                near = margin(m)
                low, high, before, upto = _side(k, low, high, before, upto, m - near, m + near, below)
                while (low, high) == (m - near, m + near) and upto - before > enough:  # the margin is for the worst pair: try less
                    if near < 1e-12 * margin(m):
                        return m, m if k + 1 < upto else None
                    near /= 16
                    low, high, before, upto = _side(k, low, high, before, upto, m - near, m + near, below)
            first, second = _order(u, v, low), _order(u, v, high)
            if upto - before <= enough:
                s = np.sort(slopes(*_inverted(first, second, np.arange(upto - before + n))[1:]))
                k = min(max(k - before, 0), len(s) - 1)
                return float(s[k]), float(s[k + 1]) if k + 1 < len(s) else None
            s = slopes(*_inverted(first, second, np.sort(rng.integers(0, upto - before, enough)))[1:])

    x, z = at(lower)
    if upper > lower:
        x = (x + (at(upper)[0] if z is None else z)) / 2
    return x


def signs(t: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """(S, tie term) of Mann-Kendall: the sum of signs of y_j - y_i over pairs with t_i < t_j, and of c (c - 1) (2 c + 5) over runs of equal y."""
    falling = _inverted(np.lexsort((y, t)), np.lexsort((t, y)))[0]
    _, c = np.unique(y, return_counts=True)
    _, same = np.unique(np.stack([t, y]), axis=1, return_counts=True)
    level = int((c * (c - 1) // 2).sum()) - int((same * (same - 1) // 2).sum())
    c = c.astype(float)
    return pair_count(t) - level - 2 * falling, float((c * (c - 1) * (2 * c + 5)).sum())
