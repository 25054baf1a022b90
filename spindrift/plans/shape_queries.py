"""Queries on cells that are not boxes, on stored results and on deficient neighbourhoods, each beside its SQL.

SQL knows the tetrahedra without planes: where the slant is taken back, a point lies in
tetrahedron (a, b, c) of a box if its fractions there satisfy 1 >= fa >= fb >= fc >= 0.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.storage import materialize, shared_path
from spindrift.operators import align, gradient, interpolate, locate, shells, topology
from spindrift.plans.queries import ORACLE, SEGMENT, STEP, _BOUNDS, _DIFF, _at, _on, _r, query, rounded
from spindrift.sources import derived
from spindrift.sources.lattice import NX, NY, SLANT, WAYS, lattice_mesh, probe_points, tetra_mesh, with_lattice
from spindrift.sources.model import Mesh, read_mesh, write_mesh

EPS = 1e-9


def _straight(x: str, y: str, z: str) -> dict[str, str]:
    """Coordinates before the slant."""
    return {"x": f"({x} - {SLANT[0]} * {z})", "y": f"({y} - {SLANT[1]} * {x})", "z": f"({z})"}


def _faces(at: dict[str, str], way: tuple[str, ...]) -> list[str]:
    """Four numbers, none of them negative inside the tetrahedron."""
    a, b, c = (f"({at[v]} - {v}min)" for v in way)
    return [f"1 - {a}", f"{a} - {b}", f"{b} - {c}", c]


# --- tetrahedra --------------------------------------------------------------------
_FLAT = _straight("x", "y", "z")
_NEAR_BOX = " AND ".join(f"sx{v} >= {v}min - {EPS} AND sx{v} <= {v}max + {EPS}" for v in "xyz")
_HOLDS = "least(" + ", ".join(f"CASE WHEN {' AND '.join(f'{g} >= -{EPS}' for g in _faces({v: f'sx{v}' for v in 'xyz'}, way))} THEN {k} END" for k, way in enumerate(WAYS)) + ")"
_TET_HITS = f"SELECT point_id, min(cell_id * 6 + {_HOLDS}) AS cell_id FROM (SELECT point_id, {', '.join(f'CAST({e} AS DOUBLE) AS sx{v}' for v, e in _FLAT.items())} FROM points) s, cells WHERE {_NEAR_BOX} GROUP BY 1"


def _located_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """The tetrahedra with their boxes written: bounds, levels and candidates read them, and each reading would join nodes and cells anew."""
    m = tetra_mesh(spark, sf_dir)
    return replace(m, cells=materialize(m.cells, "tetra-cells"))


@query(f"SELECT p.point_id, x, y, z, coalesce(h.cell_id, -1) AS cell_id FROM points p LEFT JOIN ({_TET_HITS}) h ON p.point_id = h.point_id")
def locate_exact_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shells.locate_exact(probe_points(spark, sf_dir), _located_mesh(spark, sf_dir))
    return found.withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))


def _segment_sql() -> str:
    p, q = (_straight(*map(str, end)) for end in SEGMENT)
    parts = []
    for k, way in enumerate(WAYS):
        sides = ", ".join(f"struct_pack(g := CAST({g} AS DOUBLE), h := CAST({h} AS DOUBLE))" for g, h in zip(_faces(p, way), _faces(q, way), strict=True))
        parts.append(f"SELECT cell_id * 6 + {k} AS cell_id, unnest([{sides}], recursive := true) FROM cells")
    limits = "greatest(0, coalesce(max(CASE WHEN h > g THEN g / (g - h) END), 0)) AS t, least(1, coalesce(min(CASE WHEN h < g THEN g / (g - h) END), 1)) AS u"
    return f"SELECT cell_id, {_r('t')} AS t FROM (SELECT cell_id, {limits} FROM ({' UNION ALL '.join(parts)}) GROUP BY 1) WHERE t <= u + {EPS}"


@query(_segment_sql())
def line_hits_exact_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shells.segment_cells(tetra_mesh(spark, sf_dir), *SEGMENT))


_on(
    lambda m: rounded(shells.segment_cells(m, *SEGMENT)),
    ORACLE["line_hits"].split("\n")[-1].replace("round(t, 9)", "round(t, 7) + 0.0"),
    "line_hits_exact",
)


@query("SELECT t.cell_id * 6 + k AS cell_id, CAST(4 AS BIGINT) AS triangles FROM cells t, range(0, 6) AS r(k)")
def cell_shells_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.cell_shells(tetra_mesh(spark, sf_dir)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("triangles"))


@query(f"SELECT point_id, {_r('4 + x + 2 * y + 3 * z')} AS A FROM points JOIN ({_TET_HITS}) h USING (point_id) WHERE h.cell_id IS NOT NULL")
def couple_affine_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _located_mesh(spark, sf_dir)
    field = m.nodes.select(F.lit(STEP).alias("step"), F.lit("A").alias("var"), "node_id", (F.lit(4.0) + F.col("x") + 2 * F.col("y") + 3 * F.col("z")).alias("value"))
    out = interpolate.couple(probe_points(spark, sf_dir), m, ["A"], STEP, node_values=field)
    return rounded(out.where(F.col("status") == interpolate.PASS).select("point_id", "A"))


# --- shells by area, geometry, buckets ------------------------------------------------
def _area(m) -> DataFrame:  # noqa: ANN001
    at = {n: [F.col(f"{n}{c}") for c in "xyz"] for n in "abc"}
    from spindrift.functions.geometry import cross, length, minus

    size = 0.5 * length(cross(minus(at["b"], at["a"]), minus(at["c"], at["a"])))
    return rounded(topology.cell_shells(m).groupBy("cell_id").agg(F.sum(size).alias("area")))


_on(_area, "SELECT cell_id, CAST(6 AS DOUBLE) AS area FROM cells", "cell_shell_area")
_on(
    lambda m: topology.cell_geometry(m).select("cell_id", F.size("node_ids").cast("long").alias("n_nodes"), "cx", "cy", "cz"),
    "SELECT n.cell_id, n_nodes, cx, cy, cz FROM (SELECT cell_id, count(*) AS n_nodes FROM cell_node GROUP BY 1) n LEFT JOIN cells c ON n.cell_id = c.cell_id",
    "cell_geometry",
)
_on(
    lambda m: locate.bucket_members(m.cells, locate.grid_of(m.cells, (8, 8, 8))).withColumn("cell_ids", F.array_join("cell_ids", ",")),
    f"SELECT {', '.join(f'{_at(chr(99) + a, a, 8)} AS i{a}' for a in 'xyz')}, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id) AS cell_ids FROM cells, {_BOUNDS} GROUP BY 1, 2, 3",
    "grid_bucket_members",
)


# --- the store ---------------------------------------------------------------------
def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    root = shared_path(spark, "query-store")
    write_mesh(lattice_mesh(spark, sf_dir), root, "lattice", "0 Fluid")
    return root, "lattice", "0 Fluid"


@query("SELECT step, var, cell_id, value FROM cell_scalar")
def store_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_mesh(spark, *_stored(spark, sf_dir)).cell_scalar


@query("SELECT * FROM cells")
def store_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_mesh(spark, *_stored(spark, sf_dir)).cells


@query(f"SELECT step, var, coalesce(d, span) AS max_diff FROM (SELECT step, var, max(value) - min(value) AS span FROM cell_scalar GROUP BY 1, 2) LEFT JOIN ({_DIFF}) USING (step, var)")
def store_max_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, *key = _stored(spark, sf_dir)
    derived.store_max_diffs(read_mesh(spark, root, *key), root, *key)
    return derived.read_derived(spark, root, "max_diffs", *key).select("step", "var", "max_diff")


# --- neighbourhoods in a plane ---------------------------------------------------------
_LAYERS = f"""moving AS (SELECT cell_id, cx, cy, cz, U, V, W FROM cells JOIN scalar_wide USING (cell_id) WHERE step = {STEP}),
diffs AS (SELECT a.cell_id AS cell_id, b.cx - a.cx AS dx, b.cy - a.cy AS dy, b.U - a.U AS du, b.V - a.V AS dv, b.W - a.W AS dw FROM moving a JOIN edges e ON a.cell_id = e.cell_id JOIN moving b ON b.cell_id = e.neighbor_id WHERE b.cz = a.cz),
sums AS (SELECT cell_id, count(*) AS n, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy, {', '.join(f'sum(d{v} * d{a}) AS r{v}{a}' for v in 'uvw' for a in 'xy')} FROM diffs GROUP BY 1 HAVING count(*) >= 3)"""
_PLANAR = ", ".join(
    f"{_r(e, 6)} AS g{v}{a}"
    for v in "uvw"
    for a, e in (("x", f"(syy * r{v}x - sxy * r{v}y) / (sxx * syy - sxy * sxy)"), ("y", f"(sxx * r{v}y - sxy * r{v}x) / (sxx * syy - sxy * sxy)"), ("z", "CAST(0 AS DOUBLE)"))
)


@query()
def gradient_minimum_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the own layer alone never span space, so all cells take the minimum-norm solution."""
    m = lattice_mesh(spark, sf_dir)
    flat = replace(m, edges=m.edges.where(F.abs(F.col("cell_id") - F.col("neighbor_id")) < NX * NY))
    return rounded(gradient.gradients(flat, STEP), 6)


ORACLE["gradient_minimum_norm"] = with_lattice("").rstrip() + f",\n{_LAYERS}\nSELECT cell_id, n, {_PLANAR} FROM sums"

# --- alignment of pairs --------------------------------------------------------------
#: A quarter turn about z, twice the size, moved.
_MOVE = align.Similarity(2.0, np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), np.array([1.0, -3.0, 0.5]))


@query(f"SELECT node_id, {_r('1 - 2 * y')} AS x, {_r('2 * x - 3')} AS y, {_r('2 * z + 0.5')} AS z FROM nodes")
def align_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity found from all paired nodes, applied to them."""
    nodes = lattice_mesh(spark, sf_dir).nodes
    moved = [c.alias(f"t{a}") for c, a in zip(_MOVE.columns(), "xyz", strict=True)]
    return rounded(align.fit_pairs(nodes.select("x", "y", "z", *moved)).transform(nodes))
