"""Nearest rows by one feature, exact, in sorted order.

Rows other than a query's fold stand sorted by value, and the query's k nearest
lie within k places on either side of it; nearer the query come smaller ids of
equal values. Where the first row beyond these places is not farther than the
k-th (equal values, or distances that rounding makes equal), the query looks
twice as far. Values must be finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows looked at at once.
CHUNK = 1 << 17


def _few(x: np.ndarray, k: int) -> np.ndarray:
    """Of sorted values which are among the first k of their equals."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    places = np.arange(len(x))
    return places - np.maximum.accumulate(np.where(new, places, 0)) < k


def nearest(x: np.ndarray, ids: np.ndarray, groups: np.ndarray, k: int, barred: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of queries, places of their k nearest rows, of another group if barred, by distance and id; -1 for none)."""
    up, down = np.lexsort((ids, x)), np.lexsort((-ids, x))
    for group in np.unique(groups) if barred else [None]:
        rows = up if group is None else up[groups[up] != group]
        queries = up if group is None else up[groups[up] == group]
        right = rows[_few(x[rows], k)]
        left = down if group is None else down[groups[down] != group]
        left = left[_few(x[left][::-1], k)[::-1]]  # the smallest ids of equals, which stand last
        xs, none = x[right], len(right)
        right, left = np.append(right, -1), np.append(left, -1)
        for a in range(0, len(queries), max(1, CHUNK // (2 * k))):
            yield from _windows(x, ids, queries[a : a + max(1, CHUNK // (2 * k))], xs, left, right, none, k)


def _windows(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, xs: np.ndarray, left: np.ndarray, right: np.ndarray, none: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    todo, wide = [queries], k
    while todo:
        again = []
        for q in todo:
            at = np.searchsorted(xs, x[q])
            step = np.arange(wide + 1)
            low, high = at[:, None] - 1 - step, at[:, None] + step  # one more than a window on each side
            low, high = np.where(low >= 0, low, none), np.where(high < none, high, none)
            near = np.concatenate([left[low], right[high]], 1)
            d = np.where(near >= 0, np.abs(x[q][:, None] - x[near]), np.inf)
            beyond = np.minimum(d[:, wide], d[:, -1])
            near, d = np.delete(near, [wide, 2 * wide + 1], 1), np.delete(d, [wide, 2 * wide + 1], 1)
            order = np.lexsort((ids[near], d))[:, :k]
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            done = (beyond > d[:, -1]) | np.isinf(beyond)
            yield q[done], near[done]
            if not done.all():
                again.append(q[~done])
        wide *= 2
        most = max(1, CHUNK // (2 * wide))
        todo = [part[a : a + most] for part in again for a in range(0, len(part), most)]
