"""Point location: grid-bucketed equi-joins instead of theta joins.

Buckets start at the width of the narrowest box and double with each level, axis by
axis.  A cell enters the grid of the level whose buckets are at least its box's
width, along each axis by itself, so it spans two buckets an axis at most, and a
bucket holds few cells of its level, however the mesh is graded.  A point probes its
bucket at each combination of levels that cells use.  Both sides meet on (levels,
ix, iy, iz), which hashes and splits like any equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import EPS, dot, finite, minus, point_in_box
from spindrift.functions.joins import large
from spindrift.functions.storage import materialize

#: Most buckets an axis, as a power of two, and most combinations of levels that a point probes.
DEEPEST, PROBES = 30, 64
#: Points of a bucket that one task takes together.
PART = 1 << 16


@dataclass(frozen=True)
class Grid:
    """Origin, bucket size and number of buckets by axis; the combinations of levels that cells use, in multiples of ``quantum``."""

    origin: tuple[float, float, float]
    step: tuple[float, float, float]
    dims: tuple[int, int, int]
    levels: tuple[tuple[int, int, int], ...] = ((0, 0, 0),)
    quantum: int = 1

    def bucket(self, value: Column, axis: int, level: int = 0) -> Column:
        """Bucket of a coordinate, clamped to the grid."""
        at = F.floor((value - self.origin[axis]) / (self.step[axis] * (1 << level)))
        return F.least(F.greatest(at, F.lit(0)), F.lit((self.dims[axis] - 1) >> level)).cast("long")

    def level(self, axis: int, quantum: int | None = None) -> Column:
        """Level of a cell along an axis: its buckets are at least as wide as the cell's box."""
        a, q = "xyz"[axis], quantum or self.quantum
        ratio = (F.col(f"{a}max") - F.col(f"{a}min")) / self.step[axis] * (1 - 1e-9)
        exact = F.when(ratio > 1, F.ceil(F.log2(ratio))).otherwise(0)
        return F.least(F.ceil(exact / q) * q, F.lit(max(self.dims[axis] - 1, 0).bit_length())).cast("int")

    def low(self) -> list[float]:
        return list(self.origin)


#: Buckets of the stored locator grid and of the grid that orders first hits.
LOCATOR, ORDERING = (80, 80, 40), (64, 64, 64)


def grid_of(cells: DataFrame, dims: tuple[int, int, int] | None = None) -> Grid:
    """Grid over the bounds of ``cells``, by default with buckets of the narrowest box's width.

    A row of bounds and widths and the combinations of levels reach the driver, at
    most DEEPEST to the third power; where they are over PROBES, levels are rounded up.
    """
    sides = [e for a in "xyz" for e in (F.min(f"{a}min").alias(f"{a}0"), F.max(f"{a}max").alias(f"{a}1"))]
    width = {a: F.col(f"{a}max") - F.col(f"{a}min") for a in "xyz"}
    b = cells.agg(*sides, *(F.min(F.when(w > 0, w)).alias(f"{a}w") for a, w in width.items())).first()
    if b is None or b["x0"] is None:
        return Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1, 1, 1))
    if dims is None:
        span = [b[f"{a}1"] - b[f"{a}0"] for a in "xyz"]
        dims = tuple(int(min(max(math.ceil(s / (b[f"{a}w"] or 1.0)), 1), 1 << DEEPEST)) for a, s in zip("xyz", span, strict=True))  # type: ignore[assignment]
    step = tuple(max((b[f"{a}1"] - b[f"{a}0"]) / n, 1e-12) for a, n in zip("xyz", dims, strict=True))
    grid = Grid(tuple(b[f"{a}0"] for a in "xyz"), step, dims)  # type: ignore[arg-type]
    exact = [tuple(r) for r in cells.select(*(grid.level(i).alias(a) for i, a in enumerate("xyz"))).distinct().collect()]
    tops = [max(n - 1, 0).bit_length() for n in dims]
    for quantum in range(1, DEEPEST + 1):
        used = sorted({tuple(min(-(-k // quantum) * quantum, top) for k, top in zip(levels, tops, strict=True)) for levels in exact})
        if len(used) <= PROBES:
            break
    return replace(grid, levels=tuple(used), quantum=quantum)


def grid_buckets(cells: DataFrame, grid: Grid, mode: str = "aabb") -> DataFrame:
    """(ix, iy, iz, cell_id): every bucket a cell's box overlaps, or its centroid's bucket."""
    if mode == "centroid":
        return cells.select(*(grid.bucket(F.col(f"c{a}"), i).alias(f"i{a}") for i, a in enumerate("xyz")), "cell_id")
    out = cells
    for i, a in enumerate("xyz"):
        out = out.withColumn(f"i{a}", F.explode(F.sequence(grid.bucket(F.col(f"{a}min"), i), grid.bucket(F.col(f"{a}max"), i))))
    return out.select("ix", "iy", "iz", "cell_id")


def bucket_members(cells: DataFrame, grid: Grid, mode: str = "centroid") -> DataFrame:
    """(ix, iy, iz, cell_ids): ids of each bucket, ascending; for grids whose buckets hold few cells."""
    return grid_buckets(cells, grid, mode).groupBy("ix", "iy", "iz").agg(F.array_sort(F.collect_list("cell_id")).alias("cell_ids"))


def bucketed(cells: DataFrame, grid: Grid, eps: float = 0.0) -> DataFrame:
    """A row for each bucket that a cell's box, widened by ``eps``, overlaps at its levels."""
    out = cells.select("cell_id", "cx", "cy", "cz", *(f"{a}{s}" for a in "xyz" for s in ("min", "max")), *(grid.level(i).alias(f"l{a}") for i, a in enumerate("xyz")))
    for i, a in enumerate("xyz"):
        used = sorted({levels[i] for levels in grid.levels})
        at = lambda e: F.coalesce(*(F.when(F.col(f"l{a}") == k, grid.bucket(e, i, k)) for k in used))  # noqa: B023, E731
        out = out.withColumn(f"i{a}", F.explode(F.sequence(at(F.col(f"{a}min") - eps), at(F.col(f"{a}max") + eps))))
    return out


_KEYS = [f"{k}{a}" for k in "li" for a in "xyz"]


def candidates(points: DataFrame, cells: DataFrame, grid: Grid, eps: float = 0.0, boxes: DataFrame | None = None) -> DataFrame:
    """Pairs of ``points`` (point_id, x, y, z) and cells whose box, widened by ``eps``, holds the point; each pair once.

    ``boxes`` are the cells as ``bucketed`` deals them, for callers that ask often.
    """
    low, high = grid.low(), [o + s * n for o, s, n in zip(grid.origin, grid.step, grid.dims, strict=True)]
    slack = [1e-9 * max(1.0, abs(a), abs(b)) + eps for a, b in zip(low, high, strict=True)]
    at = [F.col(a) for a in "xyz"]
    inside = points.where(point_in_box(at, [a - s for a, s in zip(low, slack, strict=True)], [b + s for b, s in zip(high, slack, strict=True)]))
    keys = [F.struct(*(F.lit(k).cast("int").alias(f"l{a}") for a, k in zip("xyz", levels, strict=True)), *(grid.bucket(F.col(a), i, levels[i]).alias(f"i{a}") for i, a in enumerate("xyz"))) for levels in grid.levels]
    probes = inside.select("point_id", "x", "y", "z", F.inline(F.array(*keys)))
    joined = probes.join(large(bucketed(cells, grid, eps) if boxes is None else boxes), _KEYS)
    return joined.where(point_in_box(at, [F.col(f"{a}min") for a in "xyz"], [F.col(f"{a}max") for a in "xyz"], eps)).drop(*_KEYS)


def _with_misses(points: DataFrame, hits: DataFrame, misses: bool) -> DataFrame:
    return points.join(large(hits), "point_id", "left").select(*points.columns, "cell_id") if misses else hits.select("point_id", "cell_id")


def locate_nearest(points: DataFrame, cells: DataFrame, grid: Grid | None = None, misses: bool = True, boxes: DataFrame | None = None) -> DataFrame:
    """Cell of each point: of the boxes that hold it, that of the nearest box centre, ties to the smaller id.

    Misses are rows with a NULL cell, or absent if not ``misses``.
    """
    grid = grid or grid_of(cells)
    found = candidates(points, cells, grid, boxes=boxes)
    off = minus([F.col(a) for a in "xyz"], [(F.col(f"{a}min") + F.col(f"{a}max")) * 0.5 for a in "xyz"])
    hits = found.groupBy("point_id").agg(F.min_by("cell_id", F.struct(dot(off, off).alias("d"), "cell_id")).alias("cell_id"))
    return _with_misses(points, hits, misses)


def locate_first(points: DataFrame, cells: DataFrame, grid: Grid | None = None, misses: bool = True, eps: float = EPS) -> DataFrame:
    """Cell of each point: of the boxes that hold it, the first in the 27 centroid buckets around it, in bucket order.

    Cells whose centroid is further off come after these, by id.
    """
    grid = grid or grid_of(cells, ORDERING)
    found = candidates(points, cells, grid_of(cells), eps)
    mine = [grid.bucket(F.col(a), i) for i, a in enumerate("xyz")]
    theirs = [grid.bucket(F.col(f"c{a}"), i) for i, a in enumerate("xyz")]
    near = (F.abs(mine[0] - theirs[0]) <= 1) & (F.abs(mine[1] - theirs[1]) <= 1) & (F.abs(mine[2] - theirs[2]) <= 1)
    order = F.struct(F.when(near, 0).otherwise(1).alias("far"), *(F.when(near, t).otherwise(0).alias(f"t{i}") for i, t in enumerate(theirs)), "cell_id")
    hits = found.groupBy("point_id").agg(F.min_by("cell_id", order).alias("cell_id"))
    return _with_misses(points, hits, misses)


def nearest_centroids(ids: np.ndarray, centres: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, squared distance) of the nearest of ``centres`` to each of ``points``; ties to the smaller id.

    Along the longest axis a point looks at its neighbours on both sides, outwards, until
    they are further off on that axis alone than the nearest one so far.
    """
    axis = int(np.ptp(centres, axis=0).argmax())
    order = np.lexsort((ids, centres[:, axis]))
    ids, centres = ids[order], centres[order]
    along, n = centres[:, axis], len(ids)
    best, chosen = np.full(len(points), np.inf), np.full(len(points), np.iinfo(np.int64).max)
    start = np.searchsorted(along, points[:, axis])
    sides = [(np.arange(len(points)), start - 1, -1), (np.arange(len(points)), start, 1)]
    while any(len(rows) for rows, _, _ in sides):
        nxt = []
        for rows, at, way in sides:
            held = (at >= 0) & (at < n)
            rows, at = rows[held], at[held]
            gap = points[rows, axis] - along[at]
            near = gap * gap <= best[rows]
            rows, at = rows[near], at[near]
            off = points[rows] - centres[at]
            d = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]
            better = (d < best[rows]) | ((d == best[rows]) & (ids[at] < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = d[better], ids[at[better]]
            nxt.append((rows, at + way, way))
        sides = nxt
    return chosen, best


def _nearest_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest centroid of each point; rows are sorted by (ix, iy, iz, part, kind), centroids (kind 0) before points."""
    last: tuple | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("ix", "iy", "iz", "part")], axis=1)
        kind, ids = batch.column("kind").to_numpy(), batch.column("id").to_numpy()
        at = np.stack([batch.column(c).to_numpy() for c in "xyz"], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(kind)], strict=True):
            if tuple(key[s]) != last:
                last, held = tuple(key[s]), []
            if kind[s] == 0:
                held.append((ids[s:e], at[s:e]))
            elif held:
                held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]  # type: ignore[list-item]
                out.append((ids[s:e], *nearest_centroids(*held[0], at[s:e])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["point_id", "cell_id", "d"])


def locate_nearest_in_bucket(points: DataFrame, cells: DataFrame, grid: Grid | None = None, misses: bool = True) -> DataFrame:
    """Cell with the nearest centroid in the point's own centroid bucket, whether or not it holds the point; ties to the smaller id.

    Points stream past their bucket's centroids, so no pairs are written.  A point that
    is not finite is a miss.
    """
    grid = grid or grid_of(cells, LOCATOR)
    whole = lambda p: finite(F.col(f"{p}x")).isNotNull() & finite(F.col(f"{p}y")).isNotNull() & finite(F.col(f"{p}z")).isNotNull()
    placed = lambda df, kind, name, p: df.where(whole(p)).select(
        *(grid.bucket(F.col(f"{p}{a}"), i).alias(f"i{a}") for i, a in enumerate("xyz")), F.lit(kind).alias("kind"), F.col(name).cast("long").alias("id"), *(F.col(f"{p}{a}").cast("double").alias(a) for a in "xyz")
    )
    probes, centroids = placed(points, 1, "point_id", ""), placed(cells, 0, "cell_id", "c")
    at = ["ix", "iy", "iz"]
    # buckets of many points are shared out; at most one row for each PART points
    crowded = materialize(probes.groupBy(at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select(*at, F.ceil(F.col("n") / PART).alias("parts")), "locate-crowded")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = probes.join(crowded, at, "left").select(*at, F.pmod(F.xxhash64("id"), parts).alias("part"), "kind", "id", *"xyz").unionByName(
        centroids.join(crowded, at, "left").select(*at, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "kind", "id", *"xyz")
    )
    grouped = dealt.repartition(*at, "part").sortWithinPartitions(*at, "part", "kind")
    found = grouped.mapInArrow(_nearest_of_buckets, "point_id long, cell_id long, d double")
    hits = found.groupBy("point_id").agg(F.min(F.struct("d", "cell_id")).alias("h")).select("point_id", F.col("h.cell_id").alias("cell_id"))
    return _with_misses(points, hits, misses)
