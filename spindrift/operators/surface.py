"""Submeshes, isosurfaces, normals and surface integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import cross, finite, length, minus
from spindrift.functions.joins import large
from spindrift.operators.fields import node_projection, of
from spindrift.sources.model import Mesh

TET_EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
TINY = 1e-15


def extract_submesh(mesh: Mesh, selection: DataFrame) -> dict[str, DataFrame]:
    """cells, cell_nodes and nodes of the selected ids; repeated, negative and unknown ids drop out."""
    ids = selection.where("cell_id >= 0").select("cell_id").distinct()
    cell_nodes = mesh.cell_nodes.join(large(ids), "cell_id", "left_semi")
    used = cell_nodes.select(F.explode("node_ids").alias("node_id")).distinct()
    return {"cells": mesh.cells.join(large(ids), "cell_id", "left_semi"), "cell_nodes": cell_nodes, "nodes": mesh.nodes.join(large(used), "node_id", "left_semi")}


def tetrahedra(cell_nodes: DataFrame) -> DataFrame:
    """(cell_id, tet, n0..n3): a cell of four nodes is one, a larger one the fan (0, i, i+1, i+2)."""
    n = F.size("node_ids")
    fan = F.when(n == 4, F.array(F.lit(1))).when(n > 4, F.sequence(F.lit(1), n - 3)).otherwise(F.array().cast("array<int>"))
    split = cell_nodes.select("cell_id", "node_ids", F.explode(fan).alias("tet"))
    pick = [F.get("node_ids", F.lit(0)), *(F.get("node_ids", F.col("tet") + k) for k in range(3))]
    return split.select("cell_id", "tet", *(p.alias(f"n{k}") for k, p in enumerate(pick)))


def isosurface(mesh: Mesh, var: str, iso: float, step: int, selection: DataFrame | None = None, node_values: str = "projected") -> DataFrame:
    """(cell_id, tet, ax..cz): a triangle for each tetrahedron the surface crosses in three edges or more.

    ``projected`` takes node values as means of the nodes' cells; ``cell`` gives all
    nodes of a cell its own value, which no surface crosses.
    """
    cell_nodes = mesh.cell_nodes if selection is None else mesh.cell_nodes.join(large(selection.select("cell_id").distinct()), "cell_id", "left_semi")
    tets = tetrahedra(cell_nodes)
    scalars = of(mesh.cell_scalar, var, step)
    if node_values == "cell":
        valued = tets.join(large(scalars.select("cell_id", finite(F.col("value")).alias("v"))), "cell_id").where("v IS NOT NULL")
        values = [F.col("v")] * 4
        corners = valued
    elif node_values == "projected":
        wanted = cell_nodes.select(F.explode("node_ids").alias("node_id")).distinct()
        means = node_projection(mesh.cell_nodes, scalars, wanted).select("node_id", F.col("value").alias("v"))
        corners, values = tets, [F.col(f"v{k}") for k in range(4)]
    else:
        raise ValueError(f"unknown node_values {node_values!r}")
    place = mesh.nodes.join(large(cell_nodes.select(F.explode("node_ids").alias("node_id")).distinct()), "node_id", "left_semi")
    if node_values == "projected":
        place = place.join(large(means), "node_id")
    # one shuffle by corner instead of one for each of the four
    long = corners.select(*(c for c in corners.columns if c[0] != "n"), F.posexplode(F.array(*(F.col(f"n{k}") for k in range(4)))).alias("k", "node_id")).join(large(place), "node_id")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    names = ["x", "y", "z"] + (["v"] if node_values == "projected" else [])
    extra = [F.max("v").alias("v")] if node_values == "cell" else []
    whole = long.groupBy("cell_id", "tet").agg(F.count(F.lit(1)).alias("corners"), *(pick(c, k) for c in names for k in range(4)), *extra).where("corners = 4")
    crossings = []
    for a, b in TET_EDGES:
        va, vb = values[a], values[b]
        t = F.least(F.greatest(F.try_divide(F.lit(iso) - va, vb - va), F.lit(0.0)), F.lit(1.0))
        at = F.struct(*((F.col(f"{c}{a}") + t * (F.col(f"{c}{b}") - F.col(f"{c}{a}"))).alias(c) for c in "xyz"))
        crossings.append(F.when((va - iso) * (vb - iso) < 0, at))
    spread = F.greatest(*values) - F.least(*values) if node_values == "projected" else F.lit(0.0)
    cut = whole.where(spread >= TINY).select("cell_id", "tet", F.filter(F.array(*crossings), lambda p: p.isNotNull()).alias("p")).where(F.size("p") >= 3)
    return cut.select("cell_id", "tet", *(F.col("p")[k][c].alias(f"{n}{c}") for k, n in enumerate("abc") for c in "xyz"))


def triangle_normals(triangles: DataFrame) -> DataFrame:
    """Unit normals of triangles (ax..cz); zero where degenerate."""
    at = {n: [F.col(f"{n}{c}") for c in "xyz"] for n in "abc"}
    n = cross(minus(at["b"], at["a"]), minus(at["c"], at["a"]))
    size = length(n)
    keys = [c for c in triangles.columns if not (len(c) == 2 and c[0] in "abc" and c[1] in "xyz")]
    return triangles.select(*keys, *(F.when(size > TINY, v / size).otherwise(0.0).alias(f"n{c}") for v, c in zip(n, "xyz", strict=True)))


def cell_points(mesh: Mesh, selection: DataFrame | None = None) -> DataFrame:
    """(cell_id, pts): the cell's node coordinates in node order."""
    cell_nodes = mesh.cell_nodes if selection is None else mesh.cell_nodes.join(large(selection.select("cell_id").distinct()), "cell_id", "left_semi")
    placed = cell_nodes.select("cell_id", F.posexplode("node_ids").alias("k", "node_id")).join(large(mesh.nodes), "node_id")
    return placed.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "node_id", "x", "y", "z"))).alias("pts"))


def _of(p: Column) -> tuple[Column, Column, Column]:
    return p["x"], p["y"], p["z"]


def surface_normals(mesh: Mesh, selection: DataFrame | None = None) -> DataFrame:
    """(cell_id, nx, ny, nz) from each cell's first three nodes; zero where degenerate."""
    pts = cell_points(mesh, selection).where(F.size("pts") >= 3)
    p = [_of(F.col("pts")[k]) for k in range(3)]
    flat = pts.select("cell_id", *(v.alias(f"{n}{c}") for n, q in zip("abc", p, strict=True) for c, v in zip("xyz", q, strict=True)))
    return triangle_normals(flat)


def fallback_normals(mesh: Mesh, selection: DataFrame | None = None, pairs: str = "all") -> DataFrame:
    """(cell_id, nx, ny, nz) for cells of any kind, as higher-order functions over their points.

    The unit cross product at the first node of the first pair of others that is not
    degenerate (``all`` pairs, or ``consecutive`` ones); else, of a line, the normal
    with the axis least aligned to it; else (1, 0, 0).
    """
    later = "sequence(i + 1, size(pts) - 1)" if pairs == "all" else "array(i + 1)"
    arm = lambda k: f"struct(pts[{k}].x - pts[0].x AS x, pts[{k}].y - pts[0].y AS y, pts[{k}].z - pts[0].z AS z)"
    product = lambda a, b: f"struct({a}.y * {b}.z - {a}.z * {b}.y AS x, {a}.z * {b}.x - {a}.x * {b}.z AS y, {a}.x * {b}.y - {a}.y * {b}.x AS z)"
    norm = lambda v: f"sqrt({v}.x * {v}.x + {v}.y * {v}.y + {v}.z * {v}.z)"
    unit = lambda v: f"struct({v}.x / {norm(v)} AS x, {v}.y / {norm(v)} AS y, {v}.z / {norm(v)} AS z)"
    one = lambda v, n, body: f"transform(array({v}), {n} -> {body})[0]"
    each = one(arm("i"), "a", one(arm("j"), "b", product("a", "b")))
    found = f"CASE WHEN size(pts) >= 3 THEN filter(flatten(transform(sequence(1, size(pts) - 2), i -> transform({later}, j -> {each}))), v -> {norm('v')} > {TINY}) ELSE array() END"
    axis = "CASE WHEN abs(t.x) <= abs(t.y) AND abs(t.x) <= abs(t.z) THEN struct(1D AS x, 0D AS y, 0D AS z) WHEN abs(t.y) <= abs(t.z) THEN struct(0D AS x, 1D AS y, 0D AS z) ELSE struct(0D AS x, 0D AS y, 1D AS z) END"
    beam = one(unit("u"), "t", one(axis, "e", one(product("t", "e"), "w", unit("w"))))
    line = f"CASE WHEN size(pts) >= 2 THEN {one(arm('1'), 'u', f'CASE WHEN {norm("u")} > {TINY} THEN {beam} END')} END"
    empty = "cast(array() AS array<struct<x:double,y:double,z:double>>)"
    made = cell_points(mesh, selection).select("cell_id", "pts", F.expr(found.replace("ELSE array()", f"ELSE {empty}")).alias("f"))
    normal = f"CASE WHEN size(f) > 0 THEN {one('f[0]', 'v', unit('v'))} ELSE coalesce({line}, struct(1D AS x, 0D AS y, 0D AS z)) END"
    return made.select("cell_id", F.expr(normal).alias("n")).select("cell_id", *(F.col("n")[c].alias(f"n{c}") for c in "xyz"))


def boundary_normals(boundary_faces: DataFrame, patch: str | None = None, degenerate: str = "unit_x") -> DataFrame:
    """(cell_id, nx, ny, nz): area-weighted unit normal of each boundary cell.

    A normal that cancels out is (1, 0, 0), or zero with ``degenerate="zero"``.
    """
    faces = boundary_faces if patch in (None, "*") else boundary_faces.where(F.col("patch") == patch)
    area = F.greatest(F.abs("area"), F.lit(TINY))
    sums = faces.groupBy("cell_id").agg(*(F.sum(F.col(f"n{c}") * area).alias(f"s{c}") for c in "xyz"), F.sum(area).alias("a"))
    mean = [F.col(f"s{c}") / F.col("a") for c in "xyz"]
    size = length(mean)
    other = (1.0, 0.0, 0.0) if degenerate == "unit_x" else (0.0, 0.0, 0.0)
    return sums.select("cell_id", *(F.when(size > TINY, m / size).otherwise(o).alias(f"n{c}") for m, o, c in zip(mean, other, "xyz", strict=True)))


def surface_cells_and_normals(mesh: Mesh) -> DataFrame:
    """Boundary normals, or normals of all cells where the zone has no boundary faces."""
    if mesh.boundary_faces.isEmpty():
        return fallback_normals(mesh)
    return boundary_normals(mesh.boundary_faces)


def surface_force(normals: DataFrame, cell_scalar: DataFrame, var: str, step: int | None = None) -> DataFrame:
    """(step, fx, fy, fz): sum of scalar times normal over the surface cells."""
    held = of(cell_scalar, var, step).select("step", "cell_id", finite(F.col("value")).alias("p")).where("p IS NOT NULL").join(large(normals), "cell_id")
    return held.groupBy("step").agg(*(F.sum(F.col("p") * F.col(f"n{c}")).alias(f"f{c}") for c in "xyz"))
