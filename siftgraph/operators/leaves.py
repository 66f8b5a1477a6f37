"""Nearest and farthest rows of a matrix in memory, exact, without all distances.

Rows are cut at medians into leaves, which have boxes. A leaf's queries take the
other leaves by the distance of the boxes and stop where no row can count any
more. Products of single precision, relative to the leaf's centre, propose rows
within a bound on their rounding; the rows left have their distances added up
feature by feature, so equal rows have equal distances. Of equal rows of a group
only the k smallest ids can be among the k nearest, and they have the same
neighbours, so copies cost nothing. Values must be finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows compared with a leaf at once.
CHUNK = 4096


def _copies(x: np.ndarray, groups: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first of its equals in its group, and whether it is one of their k smallest ids."""
    first, kept = np.arange(len(x)), np.ones(len(x), bool)
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)  # no negative zeros
    odd = np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    sums = ((bits ^ (bits >> np.uint64(31))) * odd).sum(1, dtype=np.uint64)
    _, code, counts = np.unique(sums, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[code] > 1)
    if len(some):
        order = some[np.lexsort((ids[some], *x[some].T, groups[some]))]
        new = np.ones(len(order), bool)
        new[1:] = (x[order[1:]] != x[order[:-1]]).any(1) | (groups[order[1:]] != groups[order[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        first[order], kept[order] = order[start], np.arange(len(order)) - start < k
    return first, kept


def _halved(x: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """Places cut at the median of the widest feature until a part has at most so many."""
    parts, out = [at], []
    while parts:
        part = parts.pop()
        if len(part) <= most:
            out.append(part)
            continue
        own = x[part]
        order = np.argpartition(own[:, np.ptp(own, 0).argmax()], half := len(part) // 2)
        parts += [part[order[half:]], part[order[:half]]]
    return out


def _places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask with few places, which are looked for by eights."""
    flat = mask.ravel()
    cut = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:cut].view(np.uint64) != 0)
    eight, own = np.nonzero(flat[:cut].reshape(-1, 8)[some])
    return np.concatenate([some[eight] * 8 + own, cut + np.flatnonzero(flat[cut:])])


class Leaves:
    """Rows x with ids and groups in leaves; with pure, groups that fill a leaf have leaves of their own."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, groups: np.ndarray, k: int, pure: bool = False):
        self.k = k
        self.first, kept = _copies(x, groups, ids, k)
        places = np.flatnonzero(kept)
        most = 160 if x.shape[1] <= 4 else 320 if x.shape[1] <= 8 else 640
        sets = [places]
        if pure:
            names, code, counts = np.unique(groups[places], return_inverse=True, return_counts=True)
            large = np.flatnonzero(counts >= most)
            by = np.argsort(code, kind="stable")
            ends = np.cumsum(counts)
            sets = [places[by[ends[g] - counts[g] : ends[g]]] for g in large] + [places[(counts < most)[code]]]
        leaves = [leaf for s in sets if len(s) for leaf in _halved(x, s, most)]
        self.order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.sizes = np.array([len(leaf) for leaf in leaves], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.x, self.ids, self.groups = x[self.order], ids[self.order], groups[self.order]
        if leaves:
            self.low, self.high = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)
            self.least, self.most = np.minimum.reduceat(self.groups, self.starts), np.maximum.reduceat(self.groups, self.starts)
        self.query = self.first[self.order] == self.order

    def places(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[i], self.starts[i] + self.sizes[i]) for i in leaves])

    def _chunks(self, order: np.ndarray, first: int) -> Iterator[np.ndarray]:
        """Leaves in order, some `first` rows to begin with, then CHUNK rows at once."""
        a, most = 0, first
        ends = np.cumsum(self.sizes[order])
        while a < len(order):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
            yield order[a:b]
            a, most = b, CHUNK

    def _rough(self, q: np.ndarray, squares: np.ndarray, centre: np.ndarray, at: np.ndarray, scale: float, top: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Half of what the queries' squared distances to the rows at lie under top and an error, and by query this error, a bound on a squared distance's.

        Of single precision if that tells distances of about the scale apart.
        """
        r = self.x[at] - centre
        own = np.einsum("ij,ij->i", r, r)
        reach = (np.sqrt(squares) + np.sqrt(own.max(initial=0))) ** 2 + squares + top
        d = r.shape[1] + 16
        most = reach.max(initial=0)
        kind = np.float32 if d * 2.0**-24 * most < 0.1 * scale < np.inf and 1e-24 < scale and most < 1e30 else np.float64
        error = d * (2.0**-24 if kind is np.float32 else 2.0**-53) * reach
        left, right = np.ones((len(q), q.shape[1] + 2), kind), np.ones((len(r), q.shape[1] + 2), kind)
        left[:, :-2], left[:, -1] = q, (top + error - squares) / 2
        right[:, :-2], right[:, -2] = r, own / -2
        return left @ right.T, error

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.zeros(len(a))
        for x in self.x.T:
            step = x[a] - x[b]
            d += step * step
        return d

    def nearest(self, share: tuple[int, int] = (0, 1), barred: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """For every share[1]-th leaf from share[0]: its queries' places, and (number of the query, place, squared distance) of the k nearest rows, of another group if barred, by query, distance and id."""
        for leaf in range(share[0], len(self.sizes), share[1]):
            at = np.arange(self.starts[leaf], self.starts[leaf] + self.sizes[leaf])
            at = at[self.query[at]]
            if len(at):
                yield self.order[at], *self._nearest(leaf, at, barred)

    def _nearest(self, leaf: int, at: np.ndarray, barred: bool) -> tuple[np.ndarray, ...]:
        k, n = self.k, len(at)
        low, high = self.low[leaf], self.high[leaf]
        centre = (low + high) / 2
        q = self.x[at] - centre
        squares = np.einsum("ij,ij->i", q, q)
        gap = np.maximum(0, np.maximum(self.low - high, low - self.high))
        gap = np.einsum("ij,ij->i", gap, gap) * (1 - 1e-12)
        some = np.arange(len(gap))
        if barred:
            some = some[(self.least != self.most) | (self.least != self.least[leaf]) | (self.least[leaf] != self.most[leaf])]
        order = some[np.argsort(gap[some], kind="stable")]
        held = np.full((n, k), np.inf)  # bounds on the k least distances
        found = []
        size = float(((high - low) ** 2).sum())
        for leaves in self._chunks(order, max(2 * len(at), 4 * k)):
            top = held.max(1)
            leaves = leaves[gap[leaves] <= top.max()]
            if not len(leaves):
                break
            near = self.places(leaves)
            bounded = np.isfinite(top).all()
            s, error = self._rough(q, squares, centre, near, top.mean() if bounded else size, top if bounded else 0.0)
            if bounded:
                flat = _places(s >= 0)
                i, j = np.divmod(flat, len(near))
                if barred:
                    ok = self.groups[at[i]] != self.groups[near[j]]
                    i, j, flat = i[ok], j[ok], flat[ok]
                rough = top[i] + error[i] - 2.0 * s.ravel()[flat]
                new = np.full((n, k), np.inf)
                by = np.lexsort((rough, i))
                rank = np.arange(len(by)) - np.searchsorted(i, i)
                few = by[rank < k]
                new[i[few], rank[rank < k]] = rough[few] + error[i[few]]
            else:
                every = error[:, None] - 2.0 * s
                if barred:
                    every[self.groups[at][:, None] == self.groups[near][None]] = np.inf
                new = np.partition(every, min(k, len(near)) - 1, axis=1)[:, :k] + error[:, None]
                top = np.partition(np.concatenate([held, new], 1), k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero((every <= (top + error)[:, None]) & np.isfinite(every))
                rough = every[i, j]
            held = np.partition(np.concatenate([held, new], 1), k - 1, axis=1)[:, :k]
            found.append((i, near[j], rough - error[i]))
        i, j, least = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        ok = least <= held.max(1)[i]
        i, j = i[ok], j[ok]
        d = self._distances(at[i], j)
        by = np.lexsort((self.ids[j], d, i))
        i, j, d = i[by], j[by], d[by]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[ok], self.order[j[ok]], d[ok]

    def farthest(self, share: tuple[int, int] = (0, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every share[1]-th leaf from share[0]: its queries' places and the squared distance of the farthest row of their group, themselves included."""
        for leaf in range(share[0], len(self.sizes), share[1]):
            at = np.arange(self.starts[leaf], self.starts[leaf] + self.sizes[leaf])
            at = at[self.query[at]]
            if len(at):
                yield self.order[at], self._farthest(leaf, at)

    def _farthest(self, leaf: int, at: np.ndarray) -> np.ndarray:
        low, high = self.low[leaf], self.high[leaf]
        centre = (low + high) / 2
        q = self.x[at] - centre
        squares = np.einsum("ij,ij->i", q, q)
        reach = np.maximum(self.high - low, high - self.low)
        reach = np.einsum("ij,ij->i", reach, reach) * (1 + 1e-12)
        some = np.flatnonzero((self.least <= self.most[leaf]) & (self.most >= self.least[leaf]))
        order = some[np.argsort(-reach[some], kind="stable")]
        best, out = np.full(len(at), -np.inf), np.zeros(len(at))
        for leaves in self._chunks(order, 512):
            leaves = leaves[reach[leaves] >= best.min()]
            if not len(leaves):
                break
            far = self.places(leaves)
            s, error = self._rough(q, squares, centre, far, float(reach[leaves].max()))
            every = error[:, None] - 2.0 * s
            if (self.least[leaves] != self.most[leaf]).any() or (self.most[leaves] != self.least[leaf]).any():
                every[self.groups[at][:, None] != self.groups[far][None]] = -np.inf
            best = np.maximum(best, every.max(1) - error)
            i, j = np.nonzero(every >= (best - error)[:, None])
            np.maximum.at(out, i, self._distances(at[i], far[j]))
        return out
