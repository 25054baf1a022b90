"""NumPy kernels of barycentric support: the best containing tetrahedron of a convex cell."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

WORST_CONDITION = 1e14


@dataclass(frozen=True)
class Support:
    local: tuple[int, int, int, int]
    weights: np.ndarray
    error: float
    condition: float
    margin: float


@lru_cache(maxsize=64)
def _fours(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 4)), np.int64).reshape(-1, 4)


#: Tetrahedra that are factored at once, and pairs of points and tetrahedra that are tested at once.
FACTORED, TESTED = 1 << 17, 1 << 16


def _factors(vertices: np.ndarray, combos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(corners of each cell's tetrahedra, shape of each cell, inverses and conditions of each shape's).

    Cells whose edges are equal bit for bit, as copies of one box are, are factored once.
    """
    finite = np.isfinite(vertices).all(axis=(1, 2))
    tets = np.where(finite[:, None, None], vertices, 0.0)[:, combos]
    # the last vertex is the origin: weights do not suffer from large coordinates
    edges = np.ascontiguousarray(np.swapaxes(tets[:, :, :3] - tets[:, :, 3:], 2, 3))
    shapes: dict[bytes, int] = {}
    shape = np.array([shapes.setdefault(e.tobytes(), len(shapes)) for e in edges], np.int64)
    edges = edges[np.unique(shape, return_index=True)[1]]
    singular = np.linalg.svd(edges, compute_uv=False)
    condition = np.where(singular[..., 2] > 0, singular[..., 0] / np.maximum(singular[..., 2], 1e-300), np.inf)
    good = condition <= WORST_CONDITION
    inverse = np.zeros_like(edges)
    inverse[good] = np.linalg.inv(edges[good])
    return tets, shape, inverse, np.where(good, condition, np.inf)


def deepest(points: np.ndarray, cell: np.ndarray, vertices: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, ...]:
    """For each of ``points``, the support in its own cell: the tetrahedron the point is deepest in.

    ``cell`` numbers the cells of ``vertices`` (cells, n, 3).  Returns the points that
    have a support, and of these local vertices, weights, error, condition and margin.

    Of all four-vertex tetrahedra that are not degenerate and hold the point within
    tolerance, that of the largest smallest weight, then the best condition, then the
    smallest reconstruction error.  Factors are computed once for all points.
    """
    combos = _fours(vertices.shape[1])
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros((0, 4)), np.zeros(0), np.zeros(0), np.zeros(0))]
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]
    span = max(1, FACTORED // max(1, len(combos)))
    for at in range(0, len(vertices) if len(combos) else 0, span):
        part = vertices[at : at + span]
        rows = order[slice(*np.searchsorted(ranked, [at, at + len(part)]))]
        if not len(rows):
            continue
        tets, shape, inverse, condition = _factors(part, combos)
        scale = np.maximum(np.nan_to_num(np.ptp(part, axis=1).max(axis=1), nan=1.0), 1.0)
        slack, reach = max(10 * tolerance, 1e-10), 10 * np.maximum(tolerance * scale, 1e-12)
        block = max(1, TESTED // len(combos))
        for s in range(0, len(rows), block):
            r = rows[s : s + block]
            own = cell[r] - at
            out.append(_deepest(r, points[r], combos, tets[own], inverse[shape[own]], condition[shape[own]], slack, reach[own]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _deepest(rows: np.ndarray, points: np.ndarray, combos: np.ndarray, tets: np.ndarray, inverse: np.ndarray, condition: np.ndarray, slack: float, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    with np.errstate(invalid="ignore", over="ignore"):
        first = np.einsum("ptij,ptj->pti", inverse, points[:, None] - tets[:, :, 3])
        w = np.concatenate((first, 1 - first.sum(axis=2, keepdims=True)), axis=2)
        error = np.linalg.norm(np.einsum("pti,ptij->ptj", w, tets) - points[:, None], axis=2)
        held = np.isfinite(condition) & (w >= -slack).all(axis=2) & (w <= 1 + slack).all(axis=2) & (error <= reach[:, None])
    # each key narrows the tetrahedra left over by the one before
    margin = np.where(held, w.min(axis=2), -np.inf)
    held &= margin == margin.max(axis=1, keepdims=True)
    worst = np.where(held, condition, np.inf)
    held &= worst == worst.min(axis=1, keepdims=True)
    best = np.where(held, error, np.inf).argmin(axis=1)
    k = np.flatnonzero(held.any(axis=1))
    t = best[k]
    return rows[k], combos[t], w[k, t], error[k, t], condition[k, t], margin[k, t]


def supports(points: np.ndarray, vertices: np.ndarray, tolerance: float = 1e-9) -> list[Support | None]:
    """The support of each of ``points`` in one cell of ``vertices``; None where it has none."""
    points, vertices = np.asarray(points, float).reshape(-1, 3), np.asarray(vertices, float).reshape(-1, 3)
    out: list[Support | None] = [None] * len(points)
    for k, local, w, *rest in zip(*deepest(points, np.zeros(len(points), np.int64), vertices[None], tolerance), strict=True):
        out[k] = Support(tuple(int(i) for i in local), w, *map(float, rest))
    return out
