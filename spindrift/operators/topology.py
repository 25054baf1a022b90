"""Mesh topology and geometry from faces or connectivity, as joins and aggregations."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.geometry import dot, finite, minus
from spindrift.functions.joins import large
from spindrift.sources.model import Mesh

# Local nodes of the faces of a ten-node tetrahedron.
C3D10_FACES = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 8, 7), (1, 2, 3, 5, 9, 8), (2, 0, 3, 6, 7, 9))
# VTK cell types by node count, of solids and of surfaces.
VTK_SOLID = {4: 10, 5: 14, 6: 13, 8: 12, 10: 24, 15: 26, 20: 25}
VTK_SURFACE = {3: 5, 4: 9, 6: 22, 8: 23}


def elements_from_faces(faces: DataFrame) -> DataFrame:
    """(cell_id, node_ids): sorted union of the nodes of each cell's faces (face_id, node_ids, left, right; -1 is outside)."""
    sides = faces.select("node_ids", F.explode(F.array("left", "right")).alias("cell_id")).where("cell_id >= 0")
    return sides.select("cell_id", F.explode("node_ids").alias("n")).groupBy("cell_id").agg(F.array_sort(F.collect_set("n")).alias("node_ids"))


def cells_from_nodes(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells with centroids, the means of their nodes, and boxes."""
    placed = cell_nodes.select("cell_id", F.explode("node_ids").alias("node_id")).join(large(nodes), "node_id")
    return placed.groupBy("cell_id").agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"), *(e for a in "xyz" for e in (F.min(a).alias(f"{a}min"), F.max(a).alias(f"{a}max"))))


def adjacency_from_faces(faces: DataFrame) -> DataFrame:
    """(cell_id, neighbor_id) both ways for cells that share an interior face."""
    inner = faces.where("left >= 0 AND right >= 0 AND left <> right").select("left", "right")
    both = F.explode(F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("left").alias("b"))))
    return inner.select(both.alias("e")).select(F.col("e.a").alias("cell_id"), F.col("e.b").alias("neighbor_id")).distinct()


def shared_node_threshold(element_type: Column, n_nodes: Column) -> Column:
    """Nodes two cells must share, by element family, else by node count."""
    t = F.upper(F.coalesce(element_type, F.lit("")))
    starts = lambda *names: t.rlike("^(" + "|".join(names) + ")")
    return F.when(starts("B", "T2D", "T3D", "CONN"), 1).when(starts("S", "M3D", "CPS", "CPE", "CAX"), 2).when(starts("C3D"), 3).when(n_nodes <= 2, 1).when(n_nodes <= 4, 2).otherwise(3)


def adjacency_by_nodes(cell_nodes: DataFrame) -> DataFrame:
    """(cell_id, neighbor_id) of ``cell_nodes`` (cell_id, node_ids, element_type).

    Two ten-node tetrahedra are neighbours if they share a whole face; any other pair
    if it shares the smaller of the two families' numbers of nodes.  Pairs are made
    inside a node's few cells, never over all cells.
    """
    ten = F.upper(F.coalesce("element_type", F.lit(""))).startswith("C3D10")
    marked = cell_nodes.select("cell_id", "node_ids", ten.alias("ten"), shared_node_threshold(F.col("element_type"), F.size("node_ids")).alias("need"))
    at = marked.select("cell_id", "ten", "need", F.explode(F.array_distinct("node_ids")).alias("node_id"))
    a, b = at.alias("a"), at.alias("b")
    pairs = a.join(b, (F.col("a.node_id") == F.col("b.node_id")) & (F.col("a.cell_id") < F.col("b.cell_id")) & ~(F.col("a.ten") & F.col("b.ten")))
    shared = pairs.groupBy(F.col("a.cell_id").alias("p"), F.col("b.cell_id").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("a.need", "b.need")).alias("need"))
    generic = shared.where("n >= need").select("p", "q")
    keys = F.array(*(F.array_sort(F.array(*(F.get("node_ids", F.lit(i)) for i in face))) for face in C3D10_FACES))
    owners = marked.where("ten").select("cell_id", F.explode(keys).alias("face"))
    faced = owners.alias("a").join(owners.alias("b"), (F.col("a.face") == F.col("b.face")) & (F.col("a.cell_id") < F.col("b.cell_id"))).select(F.col("a.cell_id").alias("p"), F.col("b.cell_id").alias("q"))
    found = generic.unionByName(faced).distinct()
    return found.select(F.col("p").alias("cell_id"), F.col("q").alias("neighbor_id")).unionByName(found.select(F.col("q").alias("cell_id"), F.col("p").alias("neighbor_id")))


def _newell(face: str = "pts") -> Column:
    """Newell's sum over a face's points in order, as a struct (x, y, z)."""
    turn = lambda a, b: f"aggregate({face}, struct(0D AS s, {face}[size({face}) - 1] AS l), (acc, p) -> struct(acc.s + (acc.l.{a} - p.{a}) * (acc.l.{b} + p.{b}) AS s, p AS l), acc -> acc.s)"
    return F.expr(f"struct({turn('y', 'z')} AS x, {turn('z', 'x')} AS y, {turn('x', 'y')} AS z)")


def face_geometry(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Faces of three or more nodes with unit normal, area and centre; degenerate ones have area 0."""
    placed = faces.select("face_id", "left", "right", F.posexplode("node_ids").alias("k", "node_id")).join(nodes, "node_id")
    rings = placed.groupBy("face_id", "left", "right").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("pts"), *(F.avg(a).alias(f"f{a}") for a in "xyz")).where(F.size("pts") >= 3)
    n = [F.col("n")[a] for a in "xyz"]
    size = F.sqrt(dot(n, n))
    return rings.select("face_id", "left", "right", "fx", "fy", "fz", _newell().alias("n")).select(
        "face_id", "left", "right", "fx", "fy", "fz", *(F.when(size > 1e-15, v / size).otherwise(0.0).alias(f"n{a}") for v, a in zip(n, "xyz", strict=True)), F.when(size > 1e-15, 0.5 * size).otherwise(0.0).alias("area")
    )


def boundary_faces(faces: DataFrame, nodes: DataFrame, cells: DataFrame, patch: str = "default") -> DataFrame:
    """Faces with exactly one owner, normals pointing away from its centroid; degenerate faces are skipped."""
    outer = faces.where("(left >= 0) <> (right >= 0)")
    shaped = face_geometry(outer, nodes).where("area > 0").withColumn("cell_id", F.greatest("left", "right"))
    held = shaped.join(cells.select("cell_id", "cx", "cy", "cz"), "cell_id")
    n, centre = [F.col(f"n{a}") for a in "xyz"], [F.col(f"f{a}") for a in "xyz"]
    turn = F.when(dot(n, minus(centre, [F.col(f"c{a}") for a in "xyz"])) < 0, -1.0).otherwise(1.0)
    return held.select("face_id", "cell_id", F.lit(patch).alias("patch"), *((turn * v).alias(f"n{a}") for v, a in zip(n, "xyz", strict=True)), "area", *(c.alias(f"c{a}") for c, a in zip(centre, "xyz", strict=True)))


def face_planes(faces: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, neighbor_id, nx, ny, nz, d) of interior faces, one row a side, normals towards the neighbour."""
    inner = face_geometry(faces.where("left >= 0 AND right >= 0"), nodes).where("area > 0")
    c = lambda side, p: cells.select(F.col("cell_id").alias(side), *(F.col(f"c{a}").alias(f"{p}{a}") for a in "xyz"))
    held = inner.join(c("left", "l"), "left").join(c("right", "r"), "right")
    n = [F.col(f"n{a}") for a in "xyz"]
    turn = F.when(dot(n, [F.col(f"r{a}") - F.col(f"l{a}") for a in "xyz"]) < 0, -1.0).otherwise(1.0)
    out = held.select("left", "right", *((turn * v).alias(f"n{a}") for v, a in zip(n, "xyz", strict=True)), "fx", "fy", "fz")
    d = -dot(n, [F.col(f"f{a}") for a in "xyz"])
    one = out.select(F.col("left").alias("cell_id"), F.col("right").alias("neighbor_id"), "nx", "ny", "nz", d.alias("d"))
    return one.unionByName(out.select(F.col("right").alias("cell_id"), F.col("left").alias("neighbor_id"), *((-F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"), (-d).alias("d")))


def mesh_from_faces(spark: SparkSession, nodes: DataFrame, faces: DataFrame, cell_scalar: DataFrame | None = None, meta: dict | None = None) -> Mesh:
    """Whole zone topology from nodes and faces."""
    cell_nodes = elements_from_faces(faces)
    cells = cells_from_nodes(cell_nodes, nodes)
    extra = {} if cell_scalar is None else {"cell_scalar": cell_scalar}
    return Mesh.of(spark, meta, cells=cells, nodes=nodes, cell_nodes=cell_nodes, edges=adjacency_from_faces(faces), boundary_faces=boundary_faces(faces, nodes, cells), **extra)


def nodal_to_cell(cell_nodes: DataFrame, node_scalar: DataFrame) -> DataFrame:
    """(step, var, cell_id, value): mean of a cell's nodes, where all of them have finite values."""
    wanted = cell_nodes.select("cell_id", F.size("node_ids").alias("n"), F.explode("node_ids").alias("node_id"))
    values = node_scalar.select("step", "var", "node_id", finite(F.col("value")).alias("v")).where("v IS NOT NULL")
    means = wanted.join(large(values), "node_id").groupBy("step", "var", "cell_id", "n").agg(F.avg("v").alias("value"), F.count("v").alias("held"))
    return means.where("held = n").select("step", "var", "cell_id", "value")


def integration_to_cell(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, element, value) from integration points (block, location, row, value).

    ``blocks`` has (block, n_elements, n_rows): each element has n_rows / n_elements
    consecutive rows a location; means over rows, then over locations.
    """
    per = (F.col("n_rows") / F.col("n_elements")).cast("long")
    placed = samples.join(blocks, "block").select("block", "location", F.floor(F.col("row") / per).alias("element"), finite(F.col("value")).alias("v"))
    return placed.groupBy("block", "location", "element").agg(F.avg("v").alias("m")).groupBy("block", "element").agg(F.avg("m").alias("value"))


def component(values: Column, index: int | None) -> Column:
    """One component of an array column, or its Euclidean norm."""
    if index is not None:
        return F.get(values, F.lit(index))
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))


def vtk_cell_type(element_type: Column, n_nodes: Column) -> Column:
    """VTK code: line, surface or solid type by family and node count, else a convex point set."""
    t = F.upper(F.coalesce(element_type, F.lit("")))
    surface = t.rlike("^(S|M3D|CPS|CPE|CAX)")
    line = t.rlike("^(B|T2D|T3D|CONN)") | (n_nodes == 2)
    out = F.when(line, F.when(n_nodes == 3, 21).otherwise(3)).when(n_nodes == 1, 1)
    for n, code in VTK_SURFACE.items():
        out = out.when(surface & (n_nodes == n), code)
    out = out.when(n_nodes == 3, 5)
    for n, code in VTK_SOLID.items():
        out = out.when(n_nodes == n, code)
    return out.otherwise(41)


#: Numbers that one block of plane tests may hold, so that memory does not follow the cells' node counts.
_BLOCK = 1 << 22


def hull_faces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Faces of many small convex hulls at once: (cell, outward unit normal, offset, whether each point lies on it).

    ``points`` is (cells, n, 3).  A plane through three points is a face if all others
    lie on one side; planes of several triples count once, by the points on them.
    """
    p = np.asarray(points, float)
    n = p.shape[1]
    triples = np.array([t for t in itertools.combinations(range(n), 3)], np.int64).reshape(-1, 3)
    found = []
    wide = max(1, min(len(p), _BLOCK // max(1, n * min(len(triples), 256))))
    for first in range(0, len(p), wide):
        q = p[first : first + wide]
        scale = np.maximum(np.ptp(q, axis=1).max(axis=1), 1e-300)[:, None]
        for at in range(0, len(triples), 256):
            i, j, k = triples[at : at + 256].T
            normal = np.cross(q[:, j] - q[:, i], q[:, k] - q[:, i])
            size = np.linalg.norm(normal, axis=2)
            sound = size > 1e-12 * scale * scale
            normal = normal / np.where(sound, size, 1.0)[..., None]
            offset = np.einsum("mtc,mtc->mt", normal, q[:, i])
            side = np.einsum("mtc,mnc->mtn", normal, q) - offset[..., None]
            eps = 1e-9 * scale
            under, over = side.max(axis=2) <= eps, side.min(axis=2) >= -eps
            cell, t = np.nonzero(sound & (under | over))
            turn = np.where(under[cell, t], 1.0, -1.0)
            found.append((cell + first, np.full(len(cell), at) + t, normal[cell, t] * turn[:, None], offset[cell, t] * turn, np.abs(side[cell, t]) <= eps[cell]))
    cell, triple, normal, offset, flat = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0), np.zeros((0, n), bool))
    order = np.lexsort((triple, cell))
    cell, normal, offset, flat = cell[order], normal[order], offset[order], flat[order]
    # a flat cell has its plane twice, once for each side
    keys = np.concatenate([cell[:, None].view(np.uint8).reshape(len(cell), 8), np.packbits(flat, axis=1)], axis=1)
    _, kept = np.unique(keys, axis=0, return_index=True)
    kept.sort()
    return cell[kept], normal[kept], offset[kept], flat[kept]


def _fans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, corners of a triangle) of many hulls, by cell; coplanar faces of more than three points are fanned around their first point."""
    faces, normal, _, on = hull_faces(points)
    sizes = on.sum(axis=1)
    found = []
    for n in np.unique(sizes):
        held = np.flatnonzero(sizes == n)
        flat = np.nonzero(on[held])[1].reshape(-1, n)
        p = points[faces[held][:, None], flat]
        off = p - p.mean(axis=1, keepdims=True)
        u = off[:, 0]
        v = np.cross(normal[held], u)
        turn = np.argsort(np.arctan2((off @ v[:, :, None])[..., 0], (off @ u[:, :, None])[..., 0]), axis=1, kind="stable")
        ring = np.take_along_axis(flat, turn, axis=1)
        fan = np.stack([np.repeat(ring[:, :1], n - 2, axis=1), ring[:, 1:-1], ring[:, 2:]], axis=2)
        found.append((np.repeat(held, n - 2), fan.reshape(-1, 3)))
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    face, corners = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(face, kind="stable")
    return faces[face[order]], corners[order]


def hull_triangles(points: np.ndarray) -> np.ndarray:
    """Triangles of a small convex hull, outward."""
    return _fans(np.asarray(points, float).reshape(1, -1, 3))[1]


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell ids, corners) of the batch's cells by node count; of a ten-node tetrahedron the four corners."""
    ids, ten, pts = batch.column("cell_id").to_numpy(), batch.column("ten").to_numpy(zero_copy_only=False), batch.column("pts")
    held, flat = np.diff(pts.offsets.to_numpy()), pts.flatten()
    start = np.cumsum(held) - held
    at = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
    sizes = np.where(ten, np.minimum(held, 4), held)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], at[start[rows][:, None] + np.arange(n)]


def _shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, corners in _alike(batch):
            cell, three = _fans(corners)
            k = np.arange(len(cell)) - np.searchsorted(cell, cell)
            at = corners[cell[:, None], three].reshape(-1, 9)
            names = ["cell_id", "tri", *(f"{n}{c}" for n in "abc" for c in "xyz")]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cell]), pa.array(k.astype(np.int32)), *(pa.array(at[:, i].copy()) for i in range(9))], names=names)


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, corners in _alike(batch):
            cell, normal, offset, flat = hull_faces(corners)
            # every point on one plane: no inside
            solid = ~np.isin(cell, cell[flat.all(axis=1)])
            columns = [ids[cell][solid], *(normal[solid, i].copy() for i in range(3)), offset[solid]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell_id", "nx", "ny", "nz", "d"])


def _typed(mesh: Mesh, element_types: DataFrame | None, selection: DataFrame | None = None) -> DataFrame:
    from spindrift.operators.surface import cell_points

    pts = cell_points(mesh, selection).where(F.size("pts") >= 4)
    if element_types is None:
        return pts.select("cell_id", F.lit(False).alias("ten"), "pts")
    ten = element_types.select("cell_id", F.upper("element_type").startswith("C3D10").alias("ten"))
    return pts.join(large(ten), "cell_id", "left").select("cell_id", F.coalesce("ten", F.lit(False)).alias("ten"), "pts")


def cell_shells(mesh: Mesh, element_types: DataFrame | None = None) -> DataFrame:
    """(cell_id, tri, ax..cz): convex surface of each cell of four nodes or more; ten-node tetrahedra by their corners."""
    return _typed(mesh, element_types).mapInArrow(_shells, "cell_id long, tri int, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))


def shell_planes(mesh: Mesh, element_types: DataFrame | None = None, selection: DataFrame | None = None) -> DataFrame:
    """(cell_id, nx, ny, nz, d): outward planes of the convex surfaces; the cell is where n . p <= d for all of them.

    Flat cells and cells of less than four nodes have no inside and no rows.
    """
    return _typed(mesh, element_types, selection).mapInArrow(_planes, "cell_id long, nx double, ny double, nz double, d double")


def cell_geometry(mesh: Mesh) -> DataFrame:
    """(cell_id, node_ids, cx, cy, cz): every cell of the connectivity, centroids NULL where it has none."""
    return mesh.cell_nodes.join(mesh.cells.select("cell_id", "cx", "cy", "cz"), "cell_id", "left").select("cell_id", "node_ids", "cx", "cy", "cz")
