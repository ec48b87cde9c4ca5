"""Banded alignment of word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

#: Cells of the band, over all pairs that are aligned together, at its widest.
CELLS = 1 << 17
#: Words compared in one step along a diagonal.
_RUN = 16
_FAR = -(1 << 40)


def allowed_edits(a: int, b: int, similarity: float) -> int:
    """Most edits at which sequences of these lengths are similar: 1 - edits / longer length."""
    return int(np.floor((1 - similarity) * max(a, b) + 1e-9))


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset; the longer length less this is a lower bound of the edits."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.searchsorted(ub, ua)
    at[at == len(ub)] = 0
    hit = ub[at] == ua if len(ub) else np.zeros(len(ua), bool)
    return int(np.minimum(ca[hit], cb[at[hit]]).sum())


def _within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its ``most``, for all pairs side by side.

    The band is a set of diagonals that widens by one on each side with every edit. Per diagonal it
    holds how far in the first text that many edits lead; matching words are followed at no cost, so
    the work is edits times edits, and words once.
    """
    n_a, n_b = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    ends_a, ends_b = np.full(_RUN, 1, np.uint64), np.full(_RUN, 2, np.uint64)  # never match; words are hashes of 64 bits
    a = np.concatenate([x for p in pairs for x in (p[0], ends_a)])
    b = np.concatenate([x for p in pairs for x in (p[1], ends_b)])
    at_a, at_b = np.cumsum(n_a + _RUN) - n_a - _RUN, np.cumsum(n_b + _RUN) - n_b - _RUN
    good = np.zeros(len(pairs), bool)
    alive = np.arange(len(pairs))
    run = np.arange(_RUN)

    def follow(far: np.ndarray, diagonals: np.ndarray) -> None:
        """Move ``far`` (diagonal, pair) on over matching words."""
        from_a, from_b = far + at_a, far + (at_b + diagonals[:, None])
        out = far < 0
        if out.any():  # the ends of the texts match nothing
            from_a, from_b = np.where(out, at_a + n_a, from_a), np.where(out, at_b + n_b, from_b)
        d, p = np.nonzero(a[from_a] == b[from_b])
        while len(d):
            same = a[from_a[d, p][:, None] + run] == b[from_b[d, p][:, None] + run]
            steps = np.where(same.all(axis=1), _RUN, same.argmin(axis=1))
            far[d, p] += steps
            from_a[d, p] += steps
            from_b[d, p] += steps
            on = steps == _RUN
            d, p = d[on], p[on]

    far = np.zeros((1, len(pairs)), np.int64)
    follow(far, np.zeros(1, np.int64))
    edits = 0
    while True:
        goal = n_b - n_a
        inside = np.abs(goal) <= edits
        reached = np.zeros(len(alive), bool)
        reached[inside] = far[goal[inside] + edits, np.flatnonzero(inside)] >= n_a[inside]
        good[alive[reached & (edits <= most)]] = True  # what is over may still ride along
        over = reached | (most <= edits)
        if over.all():
            return good
        if over.sum() * 4 >= len(over):
            alive, far, n_a, n_b, at_a, at_b, most = alive[~over], far[:, ~over], n_a[~over], n_b[~over], at_a[~over], at_b[~over], most[~over]
        edits += 1
        diagonals = np.arange(-edits, edits + 1)
        wide = np.full((2 * edits + 1, len(alive)), _FAR, np.int64)
        wide[1:-1] = far + 1
        np.maximum(wide[2:], far, out=wide[2:])
        np.maximum(wide[:-2], far + 1, out=wide[:-2])
        far = np.minimum(wide, np.minimum(n_a, n_b - diagonals[:, None]))
        far[far < np.maximum(0, -diagonals)[:, None]] = _FAR
        follow(far, diagonals)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the beginning and the end that they share; their edits stay as many."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n -= start
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    end = n - 1 - int(differ[-1]) if len(differ) else n
    return a[: len(a) - end], b[: len(b) - end]


def _least_edits(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edits, from the words and the pairs of neighbouring words that are shared."""
    longest = max(len(a), len(b))
    least = longest - shared_words(a, b)
    if len(a) > 1 and len(b) > 1:
        pair = lambda x: x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
        least = max(least, -(-(longest - 1 - shared_words(pair(a), pair(b))) // 2))  # an edit touches two
    return least


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Whether the edit similarity of each pair, 1 - edits / longer length, is at least ``similarity``.

    The band widens only as far as the edits that are there, so near copies cost little more than
    their words, and pairs with too few words or word pairs in common are not aligned at all.
    """
    out = np.zeros(len(pairs), bool)
    left = []
    for i, (a, b) in enumerate(pairs):
        most = allowed_edits(len(a), len(b), similarity)
        if abs(len(a) - len(b)) > most:
            continue
        x, y = _trimmed(a, b)
        if max(len(x), len(y)) <= most or not min(len(x), len(y)):
            out[i] = True
        elif _least_edits(x, y) <= most:
            left.append((most, i, x, y))
    left.sort(key=lambda g: g[0])  # pairs of like bands go together
    at = 0
    while at < len(left):
        end = at + 1
        while end < len(left) and (end + 1 - at) * (2 * left[end][0] + 1) <= CELLS:
            end += 1
        own = left[at:end]
        out[[i for _, i, _, _ in own]] = _within([(x, y) for _, _, x, y in own], np.array([most for most, *_ in own]))
        at = end
    return out
