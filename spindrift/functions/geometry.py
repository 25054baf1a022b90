"""Column builders for vectors, boxes, segments and planes; all run inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
AXES = ("x", "y", "z")
Vector = tuple[Column, Column, Column]


def columns(prefix: str = "", suffix: str = "") -> Vector:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in AXES)  # type: ignore[return-value]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Sequence[Column], b: Sequence[Column]) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def finite(value: Column) -> Column:
    """NULL for NaN and infinities, so that aggregates skip them."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def ordered(lower: Sequence[float], upper: Sequence[float]) -> tuple[list[float], list[float]]:
    return [min(a, b) for a, b in zip(lower, upper, strict=True)], [max(a, b) for a, b in zip(lower, upper, strict=True)]


def all_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def point_in_box(point: Sequence[Column], low: Sequence, high: Sequence, eps: float = 0.0) -> Column:
    """Closed containment; ``low`` and ``high`` are numbers or columns, widened by ``eps``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return all_of([(p >= as_column(a) - eps) & (p <= as_column(b) + eps) if eps else (p >= as_column(a)) & (p <= as_column(b)) for p, a, b in zip(point, low, high, strict=True)])


def box_in_box(lower: Sequence[float], upper: Sequence[float]) -> Column:
    """Cells whose own box lies inside the given one; bounds in either order."""
    lo, hi = ordered(lower, upper)
    return all_of([(F.col(f"{a}min") >= lo[i]) & (F.col(f"{a}max") <= hi[i]) for i, a in enumerate(AXES)])


def segment_entry(start: Sequence[float], end: Sequence[float], eps: float = EPS) -> Column:
    """Parameter in [0, 1] at which the segment enters a cell's box; NULL if it misses.

    Slab test: an axis along which the segment does not move only bounds where it
    is; the others narrow the interval of the parameter.
    """
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    still: list[Column] = []
    for i, a in enumerate(AXES):
        d, low, high = end[i] - start[i], F.col(f"{a}min"), F.col(f"{a}max")
        if abs(d) < eps:
            still.append(F.lit(float(start[i])).between(low - eps, high + eps))
            continue
        near, far = (low - start[i]) * (1.0 / d), (high - start[i]) * (1.0 / d)
        enter.append(F.least(near, far))
        leave.append(F.greatest(near, far))
    first = F.greatest(*enter) if len(enter) > 1 else enter[0]
    last = F.least(*leave) if len(leave) > 1 else leave[0]
    return F.when(all_of([first <= last + eps, *still]), first)


def plane_hit(origin: Sequence[float], normal: Sequence[float], eps: float = EPS, zero_normal: str = "empty") -> Column:
    """Cells whose box the plane touches: centre distance at most the box's projected radius."""
    size = math.sqrt(sum(n * n for n in normal))
    if size < eps:
        if zero_normal == "raise":
            raise ValueError("the plane's normal is zero")
        return F.lit(False)
    unit = [n / size for n in normal]
    shift = sum(o * n for o, n in zip(origin, unit, strict=True))
    centre = sum((F.col(f"{a}min") + F.col(f"{a}max")) * 0.5 * n for a, n in zip(AXES, unit, strict=True))
    radius = sum((F.col(f"{a}max") - F.col(f"{a}min")) * 0.5 * abs(n) for a, n in zip(AXES, unit, strict=True))
    return F.abs(centre - shift) <= radius + eps


def box_tolerance(low: Sequence[float], high: Sequence[float]) -> float:
    return max(1e-10 * max(1.0, *(b - a for a, b in zip(low, high, strict=True))), 1e-12)


def outside_axes(point: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> tuple[Column, Column]:
    """(array of 'x-', 'x+', ... for the sides a point is beyond, Euclidean distance to the box)."""
    tolerance = box_tolerance(low, high)
    sides, gaps = [], []
    for p, a, lo, hi in zip(point, AXES, low, high, strict=True):
        under, over = p < lo - tolerance, p > hi + tolerance
        sides.append(F.when(under, f"{a}-").when(over, f"{a}+"))
        gaps.append(F.when(under, lo - p).when(over, p - hi).otherwise(0.0))
    return F.filter(F.array(*sides), lambda s: s.isNotNull()), length(gaps)
