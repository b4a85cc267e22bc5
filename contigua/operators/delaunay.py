"""Delaunay triangulation by incremental insertion with walks between neighbouring triangles."""

from __future__ import annotations

import numpy as np


def _orient(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _in_circle(ax, ay, bx, by, cx, cy, px, py) -> float:
    """Above 0 where p lies inside the circle through a, b, c (counter-clockwise)."""
    ax, ay, bx, by, cx, cy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order of points along boustrophedon strips, so that each insertion starts near the one before."""
    strips = max(1, int(np.sqrt(len(x)) / 2))
    band = np.minimum((y * strips).astype(int), strips - 1)
    return np.lexsort((np.where(band % 2 == 0, x, -x), band))


def triangulation_edges(points: np.ndarray) -> np.ndarray:
    """Edges (i < j) of the Delaunay triangulation of points (n, 2).

    Points are inserted one by one into a triangle far around them all; the triangles whose circle holds the new point are
    replaced by a fan. Of four or more points on one circle one of the valid triangulations comes out. Points at one place
    are joined to the first of them. Points on one line are joined in their order on it.
    """
    if len(points) < 2:
        return np.zeros((0, 2), int)
    uniq, first, where = np.unique(points, axis=0, return_index=True, return_inverse=True)
    where = where.ravel()
    extra = np.stack([first[where], np.arange(len(points))], axis=1)
    extra = extra[extra[:, 0] != extra[:, 1]]
    span = np.ptp(uniq, axis=0)
    size = max(float(span.max()), 1e-300)
    p = (uniq - uniq.min(axis=0)) / size
    centred = p - p.mean(axis=0)
    if len(p) < 3 or np.linalg.matrix_rank(centred, tol=1e-12) < 2:
        line = np.lexsort((p[:, 1], p[:, 0]))
        edges = np.stack([line[:-1], line[1:]], axis=1)
    else:
        edges = _insert_all(p)
    both = np.concatenate([first[edges], extra])
    return np.unique(np.sort(both, axis=1), axis=0)


def _insert_all(p: np.ndarray) -> np.ndarray:
    n = len(p)
    far = 1e4
    xs = [*p[:, 0].tolist(), -far, far, 0.5]
    ys = [*p[:, 1].tolist(), -far, -far, far]
    corner: list[list[int]] = [[n, n + 1, n + 2]]  # counter-clockwise
    beside: list[list[int]] = [[-1, -1, -1]]  # across the edge opposite to each corner
    alive = [True]
    last = 0
    for i in _curve(p[:, 0], p[:, 1]).tolist():
        x, y = xs[i], ys[i]
        t, steps = last, 0
        while True:
            a, b, c = corner[t]
            steps += 1
            if steps > 4 * len(corner) + 10:
                t = next(k for k, ok in enumerate(alive) if ok and all(_orient(xs[corner[k][j]], ys[corner[k][j]], xs[corner[k][(j + 1) % 3]], ys[corner[k][(j + 1) % 3]], x, y) >= -1e-12 for j in range(3)))
                break
            if _orient(xs[a], ys[a], xs[b], ys[b], x, y) < 0:
                t = beside[t][2]
            elif _orient(xs[b], ys[b], xs[c], ys[c], x, y) < 0:
                t = beside[t][0]
            elif _orient(xs[c], ys[c], xs[a], ys[a], x, y) < 0:
                t = beside[t][1]
            else:
                break
        bad, todo, rim = {t}, [t], []
        while todo:
            k = todo.pop()
            for j in range(3):
                o = beside[k][j]
                if o in bad:
                    continue
                u, v = corner[k][(j + 1) % 3], corner[k][(j + 2) % 3]
                if o >= 0:
                    a, b, c = corner[o]
                    # the fan must stay counter-clockwise, so a triangle seen edge-on goes too
                    if _in_circle(xs[a], ys[a], xs[b], ys[b], xs[c], ys[c], x, y) > 1e-18 or _orient(xs[u], ys[u], xs[v], ys[v], x, y) <= 0:
                        bad.add(o)
                        todo.append(o)
                        continue
                rim.append((u, v, o, k))
        rim = [(u, v, o) for u, v, o, k in rim if o not in bad]
        for k in bad:
            alive[k] = False
        made = {}
        for u, v, o in rim:
            corner.append([i, u, v])
            beside.append([o, -1, -1])
            alive.append(True)
            k = len(corner) - 1
            made[u] = k
            if o >= 0:
                for j in range(3):
                    if corner[o][j] not in (u, v):
                        beside[o][j] = k
        for u, v, _ in rim:
            k, after = made[u], made[v]
            beside[k][1] = after
            beside[after][2] = k
        last = made[rim[0][0]]
    tri = np.array([c for c, ok in zip(corner, alive, strict=True) if ok])
    e = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    e = e[(e < n).all(axis=1)]
    return np.unique(np.sort(e, axis=1), axis=0)
