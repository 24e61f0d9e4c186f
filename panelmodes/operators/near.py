"""Neighbourhood graphs of any density whose edges are never stored: a point's neighbours are found from the points again, whenever they are asked for."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

ROWS = 1 << 24  # distances of one block of rows
BLOCK, TILE = 256, 1024  # rows of a block, and distances of a row computed at once
COUNTS = 32 << 20  # numbers of the table of neighbours by community


class Near:
    """The graph of distances below ε of the points ``u`` (n, p), in memory that grows with n only.

    Distances are those of the plain sum of squared differences. One matrix product tells most of them from ε; those too close to tell are computed plainly, so every answer is exact.
    Points with an unknown coordinate have no neighbours.
    """

    def __init__(self, u: np.ndarray) -> None:
        self.u = u = np.asarray(u, dtype=float).reshape(len(u), -1) + 0.0
        self.n, self.p = u.shape
        self.known = np.isfinite(u).all(1)
        held = u[self.known]
        centre = held.mean(0) if len(held) else np.zeros(self.p)
        v = np.where(self.known[:, None], u - centre, 0.0)
        square = (v * v).sum(1)
        self._far = float(square.max(initial=0.0))
        self._most = (float(np.abs(centre).max(initial=0.0)) + self._far**0.5) ** 2 * max(1, self.p)
        self._sides = np.column_stack([v, square, np.ones(self.n)]), np.vstack([-2.0 * v.T, np.ones(self.n), square])
        self._kept: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def _slack(self, kind: type) -> float:
        """A bound of the product's error."""
        return 8.0 * (self.p + 8) * (float(np.finfo(kind).eps) * self._far + float(np.finfo(float).eps) * self._most)

    def _sided(self, eps: float) -> tuple[np.ndarray, np.ndarray, float]:
        kind = np.float32 if self._far < 1e30 and self._slack(np.float32) < 1e-2 * eps * eps else np.float64
        if kind not in self._kept:
            self._kept = {kind: tuple(np.ascontiguousarray(s, dtype=kind) for s in self._sides)}
        return *self._kept[kind], self._slack(kind)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for d in range(self.p):
            step = self.u[i, d] - self.u[j, d]
            out += step * step
        return np.sqrt(out)

    def rows(self, start: int, end: int, eps: float) -> np.ndarray:
        """(end - start, n) BOOLEAN: which points lie closer than ``eps`` to each point from ``start`` on."""
        left, right, slack = self._sided(eps)
        out = np.empty((end - start, self.n), dtype=bool)
        high, low = left.dtype.type(eps * eps + slack), left.dtype.type(eps * eps - slack)
        held = np.empty((end - start, TILE), dtype=left.dtype)
        for at in range(0, self.n, TILE):
            to = min(self.n, at + TILE)
            got = np.matmul(left[start:end], right[:, at:to], out=held[:, : to - at] if to - at == TILE else None)
            inside = np.less(got, high, out=out[:, at:to])
            sure = got < low
            if np.count_nonzero(inside) != np.count_nonzero(sure):
                i, j = np.divmod(np.flatnonzero(inside != sure), to - at)
                inside[i, j] = self.exact(start + i, at + j) < eps
        out[np.arange(end - start), np.arange(start, end)] = False
        if not self.known.all():
            out &= self.known[None, :] & self.known[start:end, None]
        return out

    def blocks(self):  # noqa: ANN201
        size = max(1, min(self.n, BLOCK, ROWS // max(1, self.n)))
        return ((s, min(self.n, s + size)) for s in range(0, self.n, size))

    def quantile(self, q: float, drawn: int = 2_000_000, seed: int = 5) -> float:
        """The exact quantile of the positive distances, each pair counted twice, linear between neighbours; 0 for none.

        Where there are more than ``drawn`` pairs, drawn ones only tell between which bounds to look; all pairs are counted against the bounds, and the bounds widened if the wanted ranks lie outside.
        """
        whole = self if self.known.all() else Near(self.u[self.known])
        n = whole.n
        alike = np.unique(whole.u, axis=0, return_counts=True)[1] if n else np.zeros(0, int)
        zeros = int((alike * (alike - 1) // 2).sum())
        many = n * (n - 1) // 2 - zeros
        if many <= 0:
            return 0.0
        at = q * (2 * many - 1)
        first, second = int(np.floor(at)) // 2, min(int(np.floor(at)) + 1, 2 * many - 1) // 2
        room, rng = 1.0, np.random.default_rng(seed)
        if many > drawn:
            d = whole.exact(rng.integers(0, n, drawn), rng.integers(0, n, drawn))
            d = np.sort(d[d > 0])
            room = 5.0 * float(np.sqrt(max(q * (1 - q), 1e-3) / max(1, len(d))))
        while True:
            lo = float(d[int((q - room) * len(d))]) if room < q and len(d) else 0.0
            hi = float(d[int((q + room) * len(d))]) if room < 1 - q and len(d) else float("inf")
            below, value, count = whole._between(lo, hi)
            below -= zeros if lo > 0 else 0
            upto = below + np.cumsum(count)
            if below <= first and len(upto) and second < upto[-1]:
                a, b = (float(value[np.searchsorted(upto, r, side="right")]) for r in (first, second))
                t = at - np.floor(at)
                return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)
            room *= 8

    def _between(self, lo: float, hi: float) -> tuple[int, np.ndarray, np.ndarray]:
        """How many pairs are nearer than ``lo``, and the different positive distances from ``lo`` to ``hi`` with their number."""
        left, right, slack = self._sided(lo or 1e-300)
        below, kept, held = 0, [], 0
        for s, e in self.blocks():
            got = left[s:e] @ right[:, s:]
            got[:, : e - s][np.tril_indices(e - s)] = np.inf
            sure = got < lo * lo - slack
            here = (got <= hi * hi + slack) & (got < np.inf)
            below += int(np.count_nonzero(sure))
            at = np.flatnonzero((here ^ sure).ravel() if lo > 0 else here.ravel())
            d = self.exact(s + at // got.shape[1], s + at % got.shape[1])
            below += int((d < lo).sum()) if lo > 0 else 0
            d = d[(d > 0) & (d >= lo) & (d <= hi)]
            kept.append(np.unique(d, return_counts=True))
            held += len(kept[-1][0])
            if held > drawn_limit(kept):
                kept = [_merged(kept)]
                held = len(kept[0][0])
        value, count = _merged(kept)
        return below, value, count

    def connected(self, eps: float) -> bool:
        """Whether the graph is one component."""
        if self.n < 2:
            return True
        seen, todo = np.zeros(self.n, dtype=bool), [0]
        seen[0] = True
        while todo:
            v = todo.pop()
            new = np.flatnonzero(self.rows(v, v + 1, eps)[0] & ~seen)
            seen[new] = True
            if seen.all():
                return True
            todo.extend(new.tolist())
        return False


def drawn_limit(kept: list) -> int:
    """Merge when the parts hold twice what the first, merged part does, so that merging costs in proportion."""
    return 8_000_000 + 2 * len(kept[0][0])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0), np.zeros(0, int)
    value, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return value, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(value)).astype(np.int64)


def connected_eps(near: Near, grid: Sequence[float]) -> tuple[float, float]:
    """(q, ε) of the smallest q of ``grid`` whose graph is one component, else of the largest q."""
    grid, known = sorted(grid), {}
    low, high = 0, len(grid) - 1
    while low < high:
        mid = (low + high) // 2
        known[mid] = near.quantile(grid[mid])
        low, high = (low, mid) if near.connected(known[mid]) else (mid + 1, high)
    return grid[low], known[low] if low in known else near.quantile(grid[low])


def _chosen(got: np.ndarray, stay: float) -> int:
    """Where a scan in order would end that takes each gain above the last by 1e-12; -1 for nowhere. Only a gain above all before it can be taken."""
    if not got.max() > stay + 1e-12:
        return -1
    best, gain = -1, stay
    before = np.maximum.accumulate(got)
    for k in np.flatnonzero(np.concatenate([[True], got[1:] > before[:-1]])):
        if got[k] > gain + 1e-12:
            best, gain = int(k), got[k]
    return best


def communities(near: Near, eps: float, resolution: float, most: int = 50) -> np.ndarray:
    """Community of every point, named by a point: what ``cluster.louvain_labels`` gives for the listed edges of the points in order.

    The first sweep finds every point's neighbours once. As a point moves at most once in it, it also counts everyone's neighbours by community; later sweeps read these counts and
    find neighbours of moving points only. Counts that don't fit (COUNTS) are found anew each sweep.
    """
    from panelmodes.operators.cluster import louvain_labels

    n = near.n
    degree = np.zeros(n)
    for s, e in near.blocks():
        degree[s:e] = np.count_nonzero(near.rows(s, e, eps), axis=1)
    twice = float(degree.sum())
    own = np.arange(n)
    if twice == 0:
        return own
    mass = degree.copy()
    moved, counts = _first_sweep(near, eps, resolution, own, mass, degree, twice)
    if not moved:
        return own
    if counts is None:
        for _ in range(most - 1):
            if not _sweep(near, eps, resolution, own, mass, degree, twice):
                break
    else:
        _settled(near, eps, resolution, own, mass, degree, twice, counts, most - 1)
    links, names = _contracted(near, eps, own, degree, counts)
    got = louvain_labels(*(list(x) for x in zip(*((a, b) for a, b, _ in links))), names, resolution, most, [w for *_, w in links])
    to = np.arange(n)
    to[names] = [got[c] for c in names]
    return to[own]


def _gains(k: np.ndarray, v: int, resolution: float, mass: np.ndarray, degree: np.ndarray, twice: float) -> np.ndarray:
    return k - resolution * degree[v] * mass / twice


def _visited(row: np.ndarray, v: int, resolution: float, own: np.ndarray, mass: np.ndarray, degree: np.ndarray, twice: float) -> bool:
    """Move ``v`` by its row of neighbours, if it gains."""
    here = own[v]
    k = np.bincount(own, weights=row, minlength=len(own))
    mass[here] -= degree[v]
    gain = _gains(k, v, resolution, mass, degree, twice)
    stay = float(gain[here])
    gain[k == 0] = -np.inf
    best = _chosen(gain, stay)
    if best >= 0:
        own[v] = best
    mass[own[v]] += degree[v]
    return best >= 0


def _sweep(near: Near, eps: float, resolution: float, own: np.ndarray, mass: np.ndarray, degree: np.ndarray, twice: float) -> bool:
    moved = False
    for s, e in near.blocks():
        block = near.rows(s, e, eps)
        for v in range(s, e):
            if degree[v]:
                moved |= _visited(block[v - s], v, resolution, own, mass, degree, twice)
    return moved


def _first_sweep(near: Near, eps: float, resolution: float, own: np.ndarray, mass: np.ndarray, degree: np.ndarray, twice: float) -> tuple[bool, dict[int, np.ndarray] | None]:
    """(whether anything moved, everyone's number of neighbours in each community).

    A point not yet visited is alone or the one that its community is named by, so all neighbours in a community are the visited ones, counted so far, and perhaps that point.
    A point alone gains a mover 1 at most; where a community gains more, no such point is looked at.
    """
    n, moved = near.n, False
    coms: list[int] = []  # those of visited points, in order of their first
    counts: list[np.ndarray] | None = []
    for s, e in near.blocks():
        block = near.rows(s, e, eps)
        ids = np.array(coms, dtype=np.int64)
        place = {c: i for i, c in enumerate(coms)}
        if counts is not None:
            local = np.zeros((len(coms) + e - s, e - s))
            if coms:
                local[: len(coms)] = [c[s:e] for c in counts]
        joined = np.full(e - s, -1)
        for v in range(s, e):
            if not degree[v]:
                continue
            row, best = block[v - s], -2
            if counts is not None and len(coms):
                k = local[: len(coms), v - s] + (row[ids] & (ids > v))
                gain = np.where(k > 0, k - resolution * degree[v] * mass[ids] / twice, -np.inf)
                mine = place.get(v)
                stay = (float(k[mine]) if mine is not None else 0.0) - resolution * degree[v] * (mass[v] - degree[v]) / twice
                if mine is not None:
                    gain[mine] = -np.inf
                top = gain.max()
                if top > stay + 1e-12 and top > 1 + 1e-6 and not ((gain > 1) & (gain <= 1 + 1e-6)).any():
                    order = np.argsort(ids)
                    best = int(ids[order[_chosen(gain[order], stay)]])
            if best >= 0:
                mass[v] -= degree[v]
                mass[best] += degree[v]
                own[v], moved = best, True
            else:
                moved |= _visited(row, v, resolution, own, mass, degree, twice)
            if counts is not None:
                c = int(own[v])
                if c not in place:
                    place[c] = len(coms)
                    coms.append(c)
                    ids = np.array(coms, dtype=np.int64)
                joined[v - s] = place[c]
                local[place[c]] += row[s:e]
        if counts is not None:
            if len(coms) * n > COUNTS:
                counts = None
                continue
            counts.extend(np.zeros(n, dtype=np.int32) for _ in range(len(coms) - len(counts)))
            used = np.unique(joined[joined >= 0])
            hot = (joined[None, :] == used[:, None]).astype(np.float32)
            for at in range(0, n, TILE):
                added = hot @ block[:, at : at + TILE].astype(np.float32)
                for i, c in enumerate(used):
                    counts[c][at : at + TILE] += added[i].astype(np.int32)
    return moved, dict(zip(coms, counts)) if counts is not None else None


def _settled(near: Near, eps: float, resolution: float, own: np.ndarray, mass: np.ndarray, degree: np.ndarray, twice: float, counts: dict[int, np.ndarray], most: int) -> None:
    """Sweeps in order until nothing moves, by the counts of neighbours, which each move changes."""
    coms = np.array(sorted(counts))
    place = {int(c): i for i, c in enumerate(coms)}
    at = np.array([place.get(int(c), -1) for c in own])
    step = max(1, min(256, ROWS // max(1, len(coms))))
    for _ in range(most):
        moved, v = False, 0
        while v < near.n:
            end = min(near.n, v + step)
            k = np.stack([counts[int(c)][v:end] for c in coms]).astype(float)
            held = mass[coms]
            gain = np.where(k > 0, k - resolution * degree[None, v:end] * held[:, None] / twice, -np.inf)
            ours = np.maximum(at[v:end], 0)
            each = np.arange(end - v)
            stay = k[ours, each] - resolution * degree[v:end] * (held[ours] - degree[v:end]) / twice
            gain[ours, each] = -np.inf
            leaving = np.flatnonzero((gain.max(0) > stay + 1e-12) & (at[v:end] >= 0))
            if not len(leaving):
                v = end
                continue
            w = int(leaving[0])
            best = int(coms[_chosen(gain[:, w], float(stay[w]))])
            v += w
            row = near.rows(v, v + 1, eps)[0]
            counts[int(own[v])] -= row
            counts[best] += row
            mass[own[v]] -= degree[v]
            mass[best] += degree[v]
            own[v], at[v], moved = best, place[best], True
            v += 1
        if not moved:
            return


def _contracted(near: Near, eps: float, own: np.ndarray, degree: np.ndarray, counts: dict[int, np.ndarray] | None) -> tuple[list[tuple[int, int, float]], list[int]]:
    """Links (a, b, weight) of the communities of points that have neighbours, a < b or, with what is inside, a = b; and the communities."""
    names, at = np.unique(own[degree > 0], return_inverse=True)
    place = np.zeros(near.n, dtype=np.int64)
    place[degree > 0] = at
    between: dict[int, np.ndarray] = {}
    if counts is not None:
        for i, c in enumerate(names):
            between[i] = np.bincount(place, weights=counts[int(c)], minlength=len(names))
        links = [(int(names[i]), int(names[j]), float(row[j]) if i < j else float(row[j]) / 2) for i, row in between.items() for j in np.flatnonzero(row) if i <= j]
    else:
        sums: dict[tuple[int, int], float] = {}
        for s, e in near.blocks():
            block = near.rows(s, e, eps)
            for v in range(s, e):
                k = np.bincount(place, weights=block[v - s], minlength=len(names))
                for j in np.flatnonzero(k):
                    i = int(place[v])
                    if i <= j:
                        sums[i, int(j)] = sums.get((i, int(j)), 0.0) + float(k[j])
        links = [(int(names[i]), int(names[j]), w if i < j else w / 2) for (i, j), w in sums.items()]
    return links, [int(c) for c in names]
