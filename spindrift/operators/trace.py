"""Particle advection over frames and streamlines in one frame.

All particles move together: one step is a join with velocities and one location
join.  The positions of each step are written to shared storage, so plans stay
short and a lost executor repeats little.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import materialize, shared_path
from spindrift.operators.fields import VELOCITY, velocity
from spindrift.operators.locate import Grid, bucketed, grid_of, locate_nearest
from spindrift.sources.model import Mesh

MIN_SPEED = 1e-15
MAX_STEPS = 10_000


def start(points: DataFrame, cells: DataFrame, grid: Grid, boxes: DataFrame | None = None) -> DataFrame:
    """Particles (point_id, x, y, z, cell_id) of the points that a cell holds."""
    return locate_nearest(points.select("point_id", "x", "y", "z"), cells, grid, boxes=boxes).where("cell_id IS NOT NULL")


def _moved(particles: DataFrame, moving: DataFrame, dt: float) -> DataFrame:
    at = [F.col(a) + F.col(v) * dt for a, v in zip("xyz", VELOCITY, strict=True)]
    return particles.join(moving, "cell_id").select("point_id", *(e.alias(a) for e, a in zip(at, "xyz", strict=True)))


def advect(points: DataFrame, mesh: Mesh, steps: Sequence[int], dt: float = 0.01, grid: Grid | None = None) -> DataFrame:
    """(point_id, moves, x, y, z, cell_id): last position in the mesh after one Euler step a frame.

    A particle stops where it leaves the mesh or its cell lacks a velocity; ``moves``
    counts the steps that ended inside.
    """
    grid = grid or grid_of(mesh.cells)
    boxes = materialize(bucketed(mesh.cells, grid), "advect-boxes")
    alive = start(points, mesh.cells, grid, boxes).withColumn("moves", F.lit(0))
    done: DataFrame | None = None
    for step in steps:
        moving = velocity(mesh.cell_scalar, step).select("cell_id", *VELOCITY)
        target = locate_nearest(_moved(alive.select("point_id", "x", "y", "z", "cell_id"), moving, dt), mesh.cells, grid, boxes=boxes).where("cell_id IS NOT NULL")
        renamed = target.select("point_id", *(F.col(a).alias(f"n_{a}") for a in ("x", "y", "z", "cell_id")))
        # read twice below: written, it is computed once
        both = materialize(alive.join(renamed, "point_id", "left"), "advect")
        still = both.where("n_cell_id IS NULL").select("point_id", "moves", "x", "y", "z", "cell_id")
        done = still if done is None else done.unionByName(still)
        alive = both.where("n_cell_id IS NOT NULL").select("point_id", *(F.col(f"n_{a}").alias(a) for a in ("x", "y", "z", "cell_id")), (F.col("moves") + 1).alias("moves"))
    alive = alive.select("point_id", "moves", "x", "y", "z", "cell_id")
    return alive if done is None else done.unionByName(alive)


def streamlines(points: DataFrame, mesh: Mesh, step: int, dt: float = 1.0, max_steps: int = MAX_STEPS, grid: Grid | None = None) -> DataFrame:
    """(point_id, moves, x, y, z, cell_id, reason): where each streamline ends and why.

    Reasons: ``still`` (no finite speed above 1e-15, or no movement), ``left`` (the
    next point is in no cell) and ``cap``.  Rounds end once no particle moves.
    """
    grid = grid or grid_of(mesh.cells)
    moving = materialize(velocity(mesh.cell_scalar, step).select("cell_id", *VELOCITY), "stream-velocity")
    speed = F.sqrt(F.col("U") ** 2 + F.col("V") ** 2 + F.col("W") ** 2)
    boxes = materialize(bucketed(mesh.cells, grid), "stream-boxes")
    alive = materialize(start(points, mesh.cells, grid, boxes).select("point_id", F.lit(0).alias("moves"), "x", "y", "z", "cell_id"), "stream")
    # what ends in a round goes to a folder of its own, read back as one table
    done = shared_path(mesh.cells.sparkSession, "stream-ended")
    columns = ["point_id", "moves", "x", "y", "z", "cell_id"]
    schema = alive.withColumn("reason", F.lit("cap")).schema
    for k in range(max_steps):
        if alive.isEmpty():
            break
        pushed = alive.join(moving, "cell_id", "left")
        runs = speed.isNotNull() & (speed > MIN_SPEED)
        at = [F.col(a) + F.col(v) * dt for a, v in zip("xyz", VELOCITY, strict=True)]
        differs = (at[0] != F.col("x")) | (at[1] != F.col("y")) | (at[2] != F.col("z"))
        pushed = pushed.withColumn("runs", F.coalesce(runs & differs, F.lit(False)))
        goal = pushed.where("runs").select("point_id", *(e.alias(a) for e, a in zip(at, "xyz", strict=True)))
        found = locate_nearest(goal, mesh.cells, grid, boxes=boxes).where("cell_id IS NOT NULL").select("point_id", *(F.col(a).alias(f"n_{a}") for a in ("x", "y", "z", "cell_id")))
        both = materialize(pushed.select(*columns, "runs").join(found, "point_id", "left"), "stream")
        both.where("n_cell_id IS NULL").select(*columns, F.when(F.col("runs"), "left").otherwise("still").alias("reason")).write.parquet(f"{done}/round={k}")
        alive = both.where("n_cell_id IS NOT NULL").select("point_id", (F.col("moves") + 1).alias("moves"), *(F.col(f"n_{a}").alias(a) for a in ("x", "y", "z", "cell_id")))
    alive.withColumn("reason", F.lit("cap")).write.parquet(f"{done}/round=-1")
    return mesh.cells.sparkSession.read.schema(schema).parquet(done).select(*schema.fieldNames())
