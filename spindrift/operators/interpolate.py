"""Barycentric interpolation and structure-to-fluid coupling of whole point tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import box_tolerance, finite, point_in_box
from spindrift.functions.joins import large
from spindrift.functions.simplex import deepest
from spindrift.functions.storage import materialize
from spindrift.operators.fields import node_projection
from spindrift.operators.locate import Grid, candidates, grid_of
from spindrift.operators.surface import cell_points
from spindrift.sources.model import Mesh

#: Status codes of a coupled point.
PASS, OUTSIDE_MESH, NO_CONTAINING_CELL, FAILED = range(4)
STATUS = ("PASS", "OUTSIDE_MESH", "NO_CONTAINING_CELL", "INTERPOLATION_FAILED")
_SUPPORT = "point_id long, cell_id long, nodes array<long>, weights array<double>, error double, condition double, margin double"


def _find(tolerance: float):
    names = ["point_id", "cell_id", "nodes", "weights", "error", "condition", "margin"]
    rows_of = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, 4, dtype=np.int32)), pa.array(a.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            point, cell = batch.column("point_id").to_numpy(), batch.column("cell_id").to_numpy()
            at = np.stack([batch.column(a).to_numpy() for a in "xyz"], axis=1)
            ids, corners = batch.column("ids"), batch.column("corners").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            start, nodes = ids.offsets.to_numpy(), ids.flatten().to_numpy()
            start, size = start[:-1] - start[0], np.diff(start)
            _, one, which = np.unique(cell, return_index=True, return_inverse=True)
            # cells of as many vertices are one array
            for n in np.unique(size[one]):
                alike = np.flatnonzero(size[one] == n)
                number = np.full(len(one), -1)
                number[alike] = np.arange(len(alike))
                rows = np.flatnonzero(number[which] >= 0)
                first = start[one[alike]][:, None] + np.arange(n)
                own = number[which[rows]]
                k, local, *found = deepest(at[rows], own, corners[first], tolerance)
                columns = [point[rows[k]], cell[rows[k]], nodes[first[own[k][:, None], local]], *found]
                yield pa.RecordBatch.from_arrays([rows_of(c) if c.ndim == 2 else pa.array(c) for c in columns], names=names)

    return run


def located_supports(points: DataFrame, mesh: Mesh, grid: Grid | None = None, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs, best support of each point that some cell holds).

    Candidates come from the box join; the exact test prefers the largest margin,
    then the best condition, then the smaller cell id.  Rows meet by cell, so that a
    cell's vertices are gathered and factored once for all its points.
    """
    grid = grid or grid_of(mesh.cells)
    eps = box_tolerance(grid.low(), [o + s * n for o, s, n in zip(grid.origin, grid.step, grid.dims, strict=True)])
    pairs = candidates(points, mesh.cells, grid, eps).select("point_id", "x", "y", "z", "cell_id")
    # both tables are read several times: written, the join and the exact test run once
    pairs = materialize(pairs, "couple-pairs")
    shapes = cell_points(mesh, pairs.select("cell_id"))
    flat = shapes.select("cell_id", F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("corners"), F.col("pts.node_id").alias("ids"))
    held = pairs.join(large(flat), "cell_id").select("point_id", "x", "y", "z", "cell_id", "corners", "ids").mapInArrow(_find(tolerance), _SUPPORT)
    order = F.struct("margin", (-F.col("condition")).alias("c"), (-F.col("cell_id")).alias("i"))
    best = held.groupBy("point_id").agg(F.max_by(F.struct("cell_id", "nodes", "weights", "error", "condition", "margin"), order).alias("s"))
    return pairs, materialize(best.select("point_id", "s.*"), "couple-supports")


def couple(points: DataFrame, mesh: Mesh, variables: Sequence[str], step: int, grid: Grid | None = None, tolerance: float = 1e-9, node_values: DataFrame | None = None) -> DataFrame:
    """``points`` (point_id, x, y, z) with status, cell_id, error, nodes, weights and one column a variable.

    Values are the supports' weights times node values, by default the means of the
    nodes' cells; they are NULL unless the status is PASS.  A point that is not
    finite fails; one without any candidate box is outside.
    """
    at = [F.col(a) for a in "xyz"]
    whole = finite(at[0]).isNotNull() & finite(at[1]).isNotNull() & finite(at[2]).isNotNull()
    sound = points.where(whole)
    pairs, best = located_supports(sound, mesh, grid, tolerance)
    scalars = mesh.cell_scalar.where((F.col("step") == step) & F.col("var").isin(*variables))
    used = best.select(F.explode("nodes").alias("node_id")).distinct()
    values = node_projection(mesh.cell_nodes, scalars, used) if node_values is None else node_values.where((F.col("step") == step) & F.col("var").isin(*variables))
    flat = best.select("point_id", F.explode(F.arrays_zip("nodes", "weights")).alias("z")).select("point_id", F.col("z.nodes").alias("node_id"), F.col("z.weights").alias("w"))
    terms = flat.join(large(values.select("var", "node_id", finite(F.col("value")).alias("value"))), "node_id").where("value IS NOT NULL")
    dots = terms.groupBy("point_id").agg(*(F.when(F.count(F.when(F.col("var") == v, 1)) == 4, F.sum(F.when(F.col("var") == v, F.col("w") * F.col("value")))).alias(f"v_{v}") for v in variables))
    tried = pairs.select("point_id").distinct().withColumn("tried", F.lit(True))
    named = best.select("point_id", F.col("cell_id"), "error", "nodes", "weights")
    joined = points.join(large(tried), "point_id", "left").join(large(named), "point_id", "left").join(large(dots), "point_id", "left")
    complete = F.lit(True)
    for v in variables:
        complete = complete & finite(F.col(f"v_{v}")).isNotNull()
    status = F.when(~whole | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), FAILED).when(F.col("tried").isNull(), OUTSIDE_MESH).when(F.col("cell_id").isNull(), NO_CONTAINING_CELL).when(~complete, FAILED).otherwise(PASS)
    marked = joined.withColumn("status", status.cast("int"))
    return marked.select(*points.columns, "status", "cell_id", "error", "nodes", "weights", *(F.when(F.col("status") == PASS, F.col(f"v_{v}")).alias(v) for v in variables))


def status_counts(coupled: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(s) for s in STATUS))
    return coupled.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.get(names, F.col("status")).alias("status"), "n")


def interpolate(mesh: Mesh, target: Sequence[float], variables: Sequence[str], step: int, tolerance: float = 1e-9) -> dict:
    """Values at one point; raises outside the mesh, in no cell, or without finite node values."""
    spark = mesh.cells.sparkSession
    row = couple(spark.createDataFrame([(0, *map(float, target))], "point_id long, x double, y double, z double"), mesh, variables, step, tolerance=tolerance).first()
    if row["status"] == OUTSIDE_MESH:
        raise ValueError("the point is outside the mesh AABB")
    if row["status"] == NO_CONTAINING_CELL:
        raise ValueError("no cell contains the point")
    if row["status"] == FAILED:
        raise ValueError("a supporting node has no finite value")
    return {"cell_id": row["cell_id"], "nodes": row["nodes"], "weights": row["weights"], "error": row["error"], "values": {v: row[v] for v in variables}}


def inside_bounds(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    return points.where(point_in_box([F.col(a) for a in "xyz"], list(low), list(high), box_tolerance(low, high)))
