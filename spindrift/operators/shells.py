"""Exact point and segment tests against the cells' convex shells.

A cell is the set where n . p <= d for all planes of its shell, so both tests are
aggregates over a cell's few planes: the largest distance of a point, and the
interval of a segment's parameter that all planes leave.  Boxes choose the candidates
before, so planes are made for cells that some point or the segment can hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import EPS, columns, dot, segment_entry
from spindrift.functions.joins import large
from spindrift.functions.storage import materialize
from spindrift.operators.locate import Grid, candidates, grid_of
from spindrift.operators.topology import shell_planes
from spindrift.sources.model import Mesh

#: A segment runs along a plane if its distance to it changes by less.
PARALLEL = 1e-12


def locate_exact(points: DataFrame, mesh: Mesh, grid: Grid | None = None, misses: bool = True, eps: float = EPS, element_types: DataFrame | None = None) -> DataFrame:
    """Cell of each point whose shell, widened by ``eps``, holds it; of several the smaller id.

    Misses are rows with a NULL cell, or absent if not ``misses``.
    """
    # read twice: for the cells that need planes and for the test
    pairs = materialize(candidates(points, mesh.cells, grid or grid_of(mesh.cells), eps).select("point_id", "x", "y", "z", "cell_id"), "shell-pairs")
    planes = shell_planes(mesh, element_types, pairs)
    faces = planes.groupBy("cell_id").agg(F.collect_list(F.struct("nx", "ny", "nz", "d")).alias("faces"))
    beyond = F.exists("faces", lambda f: F.col("x") * f["nx"] + F.col("y") * f["ny"] + F.col("z") * f["nz"] - f["d"] > eps)
    hits = pairs.join(large(faces), "cell_id").where(~beyond).groupBy("point_id").agg(F.min("cell_id").alias("cell_id"))
    return points.join(large(hits), "point_id", "left").select(*points.columns, "cell_id") if misses else hits


def segment_cells(mesh: Mesh, start: Sequence[float], end: Sequence[float], eps: float = EPS, element_types: DataFrame | None = None) -> DataFrame:
    """(cell_id, t) of the cells whose shell the segment meets, with the parameter at which it enters."""
    boxed = mesh.cells.where(segment_entry(start, end, eps).isNotNull()).select("cell_id")
    at, way = [F.lit(float(v)) for v in start], [F.lit(float(b) - float(a)) for a, b in zip(start, end, strict=True)]
    # signed distance of the start, outside positive, and its change along the segment
    normal = columns("n")
    gap, change = dot(at, normal) - F.col("d"), dot(way, normal)
    crossing = F.try_divide(-gap, change)
    limits = shell_planes(mesh, element_types, boxed).groupBy("cell_id").agg(
        F.max(F.when(change < -PARALLEL, crossing)).alias("enter"),
        F.min(F.when(change > PARALLEL, crossing)).alias("leave"),
        F.max(F.when(F.abs(change) <= PARALLEL, gap)).alias("beside"),
    )
    first, last = F.greatest(F.lit(0.0), F.col("enter")), F.least(F.lit(1.0), F.col("leave"))
    kept = limits.where((first <= last + eps) & F.coalesce(F.col("beside") <= eps, F.lit(True)))
    return kept.select("cell_id", first.alias("t"))
