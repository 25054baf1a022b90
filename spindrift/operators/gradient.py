"""Least-squares velocity gradients, Q-criterion and vortex cells.

A gradient is the solution of 3 x 3 normal equations: six sums of offset products
and nine of offsets with velocity differences, one aggregation for all cells.  The
closed form runs in codegen; rank-deficient cells alone go to a NumPy kernel for
the minimum-norm solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.fields import VELOCITY, range_coord, velocity
from spindrift.sources.model import Mesh

G = [f"g{u}{a}" for u in "uvw" for a in "xyz"]
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def neighbour_sums(mesh: Mesh, step: int, roi: DataFrame | None = None, halo: bool = True, min_distance: float = 1e-15) -> DataFrame:
    """(cell_id, n, sxx..szz, rux..rwz) over the neighbours of each cell that have velocities.

    ``halo`` False uses velocities inside the region only.
    """
    moving = velocity(mesh.cell_scalar, step).select("cell_id", *VELOCITY).join(mesh.cells.select("cell_id", "cx", "cy", "cz"), "cell_id")
    inside = moving if roi is None else moving.join(roi.select("cell_id").distinct(), "cell_id", "left_semi")
    around = moving if halo or roi is None else inside
    other = around.select(*(F.col(c).alias(f"o_{c}") for c in ("cell_id", "cx", "cy", "cz", *VELOCITY)))
    pairs = inside.join(mesh.edges, "cell_id", "left").join(other, F.col("neighbor_id") == F.col("o_cell_id"), "left")
    d = {a: F.col(f"o_c{a}") - F.col(f"c{a}") for a in "xyz"}
    u = {v.lower(): F.col(f"o_{v}") - F.col(v) for v in VELOCITY}
    flat = pairs.select("cell_id", *(e.alias(f"d{a}") for a, e in d.items()), *(e.alias(f"d{v}") for v, e in u.items()))
    kept = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) >= min_distance
    on = lambda e: F.sum(F.when(kept, e))
    return flat.groupBy("cell_id").agg(
        F.count(F.when(kept, 1)).alias("n"),
        *(on(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"s{a}{b}") for a, b in _PAIRS),
        *(on(F.col(f"d{v}") * F.col(f"d{a}")).alias(f"r{v}{a}") for v in "uvw" for a in "xyz"),
    )


def _closed_form() -> tuple[Column, list[Column]]:
    s = lambda a, b: F.col(f"s{min(a, b)}{max(a, b)}")
    xx, xy, xz, yy, yz, zz = (s(a, b) for a, b in _PAIRS)
    # cofactors of the symmetric matrix
    co = [[yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy], [xz * yz - xy * zz, xx * zz - xz * xz, xy * xz - xx * yz], [xy * yz - xz * yy, xy * xz - xx * yz, xx * yy - xy * xy]]
    det = xx * co[0][0] + xy * co[0][1] + xz * co[0][2]
    solved = []
    for v in "uvw":
        r = [F.col(f"r{v}{a}") for a in "xyz"]
        solved += [F.try_divide(co[i][0] * r[0] + co[i][1] * r[1] + co[i][2] * r[2], F.col("det")) for i in range(3)]
    return det, solved


def _minimum_norm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        s = np.empty((len(rows), 3, 3))
        for i, a in enumerate("xyz"):
            for j, b in enumerate("xyz"):
                s[:, i, j] = rows[f"s{min(a, b)}{max(a, b)}"]
        r = np.stack([np.stack([rows[f"r{v}{a}"] for a in "xyz"], axis=1) for v in "uvw"], axis=2)
        g = np.linalg.pinv(s, rcond=1e-10, hermitian=True) @ r if len(rows) else r
        out = {"cell_id": rows["cell_id"].to_numpy(), "n": rows["n"].to_numpy()}
        yield pd.DataFrame(out | {f"g{v}{a}": g[:, i, k] for k, v in enumerate("uvw") for i, a in enumerate("xyz")})


def gradients(mesh: Mesh, step: int, roi: DataFrame | None = None, min_neighbors: int = 3, halo: bool = True, deficient: str = "solve", min_det: float = 1e-9) -> DataFrame:
    """(cell_id, n, gux..gwz), g of component u along x and so on, of cells with ``min_neighbors`` neighbours.

    Cells whose neighbours do not span space get the minimum-norm solution, or are
    left out with ``deficient="drop"``.
    """
    det, solved = _closed_form()
    sums = neighbour_sums(mesh, step, roi, halo).where(F.col("n") >= max(1, min_neighbors)).withColumn("det", det)
    regular = sums.where(F.abs("det") > min_det).select("cell_id", "n", *(e.alias(n) for e, n in zip(solved, G, strict=True)))
    if deficient == "drop":
        return regular
    schema = "cell_id long, n long, " + ", ".join(f"{g} double" for g in G)
    return regular.unionByName(sums.where(~(F.abs("det") > min_det)).drop("det").mapInPandas(_minimum_norm, schema))


def q_of_gradient() -> Column:
    """Half the difference of the squared norms of rotation and strain."""
    g = {n: F.col(n) for n in G}
    return -0.5 * (g["gux"] * g["gux"] + g["gvy"] * g["gvy"] + g["gwz"] * g["gwz"]) - (g["guy"] * g["gvx"] + g["guz"] * g["gwx"] + g["gvz"] * g["gwy"])


def q_criterion(
    mesh: Mesh, lower: Sequence[float], upper: Sequence[float], step: int, tau: float | None = None, min_neighbors: int = 3, halo: bool = True, fallback_zero: bool = False, mode: str = "aabb", deficient: str = "solve"
) -> DataFrame:
    """(cell_id, q) of the cells in a box; ``tau`` keeps q at or above it.

    ``fallback_zero`` gives cells with velocities but too few neighbours a q of zero.
    """
    roi = range_coord(mesh.cells, lower, upper, mode)
    out = gradients(mesh, step, roi, min_neighbors, halo, deficient).select("cell_id", q_of_gradient().alias("q"))
    if fallback_zero:
        held = velocity(mesh.cell_scalar, step).select("cell_id").join(roi, "cell_id", "left_semi")
        out = held.join(out, "cell_id", "left").select("cell_id", F.coalesce("q", F.lit(0.0)).alias("q"))
    return out if tau is None else out.where(F.col("q") >= tau)


def vortex_cells(mesh: Mesh, lower: Sequence[float], upper: Sequence[float], step: int, tau: float, **options) -> DataFrame:
    """Cells with q at or above ``tau`` in a box, strongest first."""
    return q_criterion(mesh, lower, upper, step, tau, **options).orderBy(F.desc("q"), "cell_id")
