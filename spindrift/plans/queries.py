"""Registered queries over the lattice, each beside its DuckDB SQL.

Floating sums depend on their order, so such results are rounded before they are
compared; minima, maxima and copies are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.geometry import box_in_box
from spindrift.operators import fields, gradient, interpolate, locate, surface, topology, trace
from spindrift.sources.lattice import lattice_mesh, probe_points, with_lattice
from spindrift.sources.model import Mesh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BOX_LOW, BOX_HIGH = (2.0, 1.0, 1.0), (15.6, 8.8, 8.2)
SEGMENT = ((-1.0, 2.4, 0.4), (21.0, 6.6, 3.3))
PLANE = ((5.3, 0.0, 0.0), (1.0, 0.3, -0.2))
STEP = 3


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` follows the lattice's CTEs."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = with_lattice(sql)
        return f

    return put


def _on(f: Callable[[Mesh], DataFrame], sql: str | None, name: str) -> None:
    query(sql, name)(lambda spark, sf_dir: f(lattice_mesh(spark, sf_dir)))


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles to ``digits`` places, minus zero as zero."""
    return df.select(*((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _r(expr: str, digits: int = 7) -> str:
    return f"round({expr}, {digits}) + 0.0"


_MEMBER = " AND ".join(f"{a}min >= {lo} AND {a}max <= {hi}" for a, lo, hi in zip("xyz", BOX_LOW, BOX_HIGH, strict=True))
_CENTRED = " AND ".join(f"c{a} >= {lo} AND c{a} <= {hi}" for a, lo, hi in zip("xyz", BOX_LOW, BOX_HIGH, strict=True))

# --- scans -----------------------------------------------------------------
_on(lambda m: m.cells, "SELECT * FROM cells", "scan_cells")
_on(lambda m: m.nodes, "SELECT * FROM nodes", "scan_nodes")
_on(lambda m: m.edges, "SELECT * FROM edges", "scan_edges")
_on(lambda m: m.cell_nodes.select("cell_id", F.explode("node_ids").alias("node_id")), "SELECT cell_id, node_id FROM cell_node", "scan_cell_nodes")
_on(lambda m: m.boundary_faces.where("patch = 'hull'"), "SELECT * FROM boundary_faces WHERE patch = 'hull'", "scan_boundary_faces")
_on(lambda m: fields.wide(m.cell_scalar, ["U", "V", "W", "P"]), "SELECT step, cell_id, U, V, W, P FROM scalar_wide", "scan_scalar_wide")
_on(lambda m: fields.of(m.cell_scalar, "P", STEP).select("value"), f"SELECT value FROM cell_scalar WHERE var = 'P' AND step = {STEP}", "scan_one_variable")
_on(lambda m: surface.extract_submesh(m, m.cells.where(box_in_box(BOX_LOW, BOX_HIGH)))["nodes"], f"SELECT * FROM nodes WHERE node_id IN (SELECT node_id FROM cell_node JOIN cells USING (cell_id) WHERE {_MEMBER})", "scan_node_subset")


# --- lookups and ranges ------------------------------------------------------
def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event, over all cells and some ids past the last."""
    e, past = F.col("event_id").cast("long"), spark.read.parquet(f"{sf_dir}/part.parquet").count() + 500
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(e.alias("ord"), (e * 13 % past).alias("cell_id"))


_REQUESTS = "(SELECT CAST(event_id AS BIGINT) AS ord, CAST(event_id * 13 % (SELECT count(*) + 500 FROM part) AS BIGINT) AS cell_id FROM events) r"


@query(f"SELECT ord, r.cell_id AS cell_id, value FROM {_REQUESTS} LEFT JOIN (SELECT * FROM cell_scalar WHERE var = 'P' AND step = {STEP}) s ON r.cell_id = s.cell_id")
def point_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.point_query(_requests(spark, sf_dir), lattice_mesh(spark, sf_dir).cell_scalar, "P", STEP)


@query(f"SELECT ord, r.cell_id AS cell_id, U, P, K FROM {_REQUESTS} LEFT JOIN (SELECT * FROM scalar_wide WHERE step = {STEP}) s ON r.cell_id = s.cell_id")
def matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.matrix_query(_requests(spark, sf_dir), lattice_mesh(spark, sf_dir).cell_scalar, ["U", "P", "K"], STEP)


@query(f"SELECT ord, r.cell_id AS cell_id, U, V, W FROM {_REQUESTS} LEFT JOIN (SELECT * FROM scalar_wide WHERE step = {STEP}) s ON r.cell_id = s.cell_id")
def velocity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.velocity_query(_requests(spark, sf_dir), lattice_mesh(spark, sf_dir).cell_scalar, STEP)


_on(lambda m: fields.contiguous_query(m.cell_scalar, "U", STEP, 100, 180), f"SELECT cell_id, value FROM cell_scalar WHERE var = 'U' AND step = {STEP} AND cell_id BETWEEN 100 AND 180", "contiguous_query")
_on(lambda m: fields.range_var(m.cell_scalar, "P", 60000.0, 80000.0, STEP), f"SELECT cell_id FROM cell_scalar WHERE var = 'P' AND step = {STEP} AND value BETWEEN 60000 AND 80000", "range_var")
_on(lambda m: fields.range_coord(m.cells, BOX_HIGH, BOX_LOW), f"SELECT cell_id FROM cells WHERE {_MEMBER}", "range_coord_aabb")
_on(lambda m: fields.range_coord(m.cells, BOX_LOW, BOX_HIGH, "centroid"), f"SELECT cell_id FROM cells WHERE {_CENTRED}", "range_coord_centroid")
_on(lambda m: fields.element_ids_in_range(m.cells, BOX_LOW, BOX_HIGH), f"SELECT cell_id + 1 AS element_id FROM cells WHERE {_CENTRED}", "element_ids_box")
_on(lambda m: fields.element_ids_in_range(m.cells, BOX_LOW, BOX_HIGH, m.cell_source), f"SELECT source_label AS element_id FROM cells JOIN cell_source USING (cell_id) WHERE {_CENTRED}", "element_labels_box")


def _line_hits(m: Mesh) -> DataFrame:
    from spindrift.functions.geometry import segment_entry

    return m.cells.select("cell_id", segment_entry(*SEGMENT).alias("t")).where("t IS NOT NULL").select("cell_id", F.round("t", 9).alias("t")).orderBy("t", "cell_id")


def _slabs() -> tuple[str, str]:
    near, far = [], []
    for a, p, q in zip("xyz", *SEGMENT, strict=True):
        lo, hi = f"({a}min - ({p})) / ({q} - ({p}))", f"({a}max - ({p})) / ({q} - ({p}))"
        near.append(f"least({lo}, {hi})")
        far.append(f"greatest({lo}, {hi})")
    return f"greatest(0.0, {', '.join(near)})", f"least(1.0, {', '.join(far)})"


_on(_line_hits, f"SELECT cell_id, round(t, 9) AS t FROM (SELECT cell_id, CAST({_slabs()[0]} AS DOUBLE) AS t, CAST({_slabs()[1]} AS DOUBLE) AS u FROM cells) WHERE t <= u + 1e-9", "line_hits")


def _plane_hits(m: Mesh) -> DataFrame:
    from spindrift.functions.geometry import plane_hit

    return m.cells.where(plane_hit(*PLANE)).select("cell_id")


_SIZE = "sqrt(CAST(1.13 AS DOUBLE))"
_on(_plane_hits, f"SELECT cell_id FROM cells WHERE abs(((cx - 5.3) * 1.0 + cy * 0.3 + cz * -0.2) / {_SIZE}) <= 0.5 * (1.0 + 0.3 + 0.2) / {_SIZE} + 1e-9", "plane_hits")


@query(
    """SELECT point_id, CASE WHEN sides = '' THEN true ELSE false END AS inside, sides, round(distance, 7) + 0.0 AS distance FROM (
    SELECT point_id, concat_ws(',', CASE WHEN x < x0 - tol THEN 'x-' WHEN x > x1 + tol THEN 'x+' END, CASE WHEN y < y0 - tol THEN 'y-' WHEN y > y1 + tol THEN 'y+' END, CASE WHEN z < z0 - tol THEN 'z-' WHEN z > z1 + tol THEN 'z+' END) AS sides,
           sqrt(pow(CASE WHEN x < x0 - tol THEN x0 - x WHEN x > x1 + tol THEN x - x1 ELSE 0 END, 2) + pow(CASE WHEN y < y0 - tol THEN y0 - y WHEN y > y1 + tol THEN y - y1 ELSE 0 END, 2) + pow(CASE WHEN z < z0 - tol THEN z0 - z WHEN z > z1 + tol THEN z - z1 ELSE 0 END, 2)) AS distance
    FROM points, (SELECT min(xmin) x0, max(xmax) x1, min(ymin) y0, max(ymax) y1, min(zmin) z0, max(zmax) z1, 2e-9 AS tol FROM cells))"""
)
def bounds_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.functions.geometry import outside_axes

    b = fields.mesh_bounds(lattice_mesh(spark, sf_dir).cells).first()
    sides, distance = outside_axes([F.col(a) for a in "xyz"], [b[f"{a}min"] for a in "xyz"], [b[f"{a}max"] for a in "xyz"])
    return rounded(probe_points(spark, sf_dir).select("point_id", (F.size(sides) == 0).alias("inside"), F.array_join(sides, ",").alias("sides"), distance.alias("distance")))


# --- point location ----------------------------------------------------------
_INSIDE = "x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax AND z >= zmin AND z <= zmax"
_WIDE = "x >= xmin - 1e-9 AND x <= xmax + 1e-9 AND y >= ymin - 1e-9 AND y <= ymax + 1e-9 AND z >= zmin - 1e-9 AND z <= zmax + 1e-9"
_DISTANCE = "(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)"
_BOUNDS = "(SELECT min(xmin) x0, max(xmax) x1, min(ymin) y0, max(ymax) y1, min(zmin) z0, max(zmax) z1 FROM cells)"


def _at(value: str, axis: str, n: int) -> str:
    return f"CAST(least(greatest(floor(({value} - {axis}0) / (({axis}1 - {axis}0) / {n}.0)), 0), {n - 1}) AS BIGINT)"


def _found(located: DataFrame) -> DataFrame:
    """A miss as cell -1, so that ids stay integers in every engine."""
    return located.withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))


@query(f"SELECT p.point_id, x, y, z, coalesce(h.cell_id, -1) AS cell_id FROM points p LEFT JOIN (SELECT point_id, arg_min(cell_id, d * 1e6 + cell_id * 1e-9) AS cell_id FROM (SELECT point_id, cell_id, {_DISTANCE} AS d FROM points, cells WHERE {_INSIDE}) GROUP BY 1) h ON p.point_id = h.point_id")
def locate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(locate.locate_nearest(probe_points(spark, sf_dir), lattice_mesh(spark, sf_dir).cells))


_FIRST = f"""
pairs AS (SELECT point_id, cell_id, {', '.join(f"{_at(a, a, 64)} AS p{a}, {_at('c' + a, a, 64)} AS q{a}" for a in 'xyz')} FROM points, cells, {_BOUNDS} WHERE {_WIDE}),
near AS (SELECT *, abs(px - qx) <= 1 AND abs(py - qy) <= 1 AND abs(pz - qz) <= 1 AS n FROM pairs),
ranked AS (SELECT point_id, cell_id, row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN n THEN 0 ELSE 1 END, CASE WHEN n THEN qx ELSE 0 END, CASE WHEN n THEN qy ELSE 0 END, CASE WHEN n THEN qz ELSE 0 END, cell_id) AS k FROM near)"""


@query(f"SELECT p.point_id, x, y, z, coalesce(h.cell_id, -1) AS cell_id FROM points p LEFT JOIN (SELECT point_id, cell_id FROM ranked WHERE k = 1) h ON p.point_id = h.point_id")
def locate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(locate.locate_first(probe_points(spark, sf_dir), lattice_mesh(spark, sf_dir).cells))


ORACLE["locate_first"] = ORACLE["locate_first"].replace("\nSELECT p.point_id", f",{_FIRST}\nSELECT p.point_id")


@query(
    f"""SELECT p.point_id, x, y, z, coalesce(h.cell_id, -1) AS cell_id FROM points p LEFT JOIN (SELECT point_id, arg_min(cell_id, d * 1e6 + cell_id * 1e-9) AS cell_id FROM (
    SELECT point_id, cell_id, {_DISTANCE} AS d FROM points, cells, {_BOUNDS} WHERE {' AND '.join(f"{_at(a, a, n)} = {_at('c' + a, a, n)}" for a, n in zip('xyz', (20, 10, 10), strict=True))}) GROUP BY 1) h ON p.point_id = h.point_id"""
)
def locate_nearest_in_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lattice_mesh(spark, sf_dir).cells
    return _found(locate.locate_nearest_in_bucket(probe_points(spark, sf_dir), cells, locate.grid_of(cells, (20, 10, 10))))


_on(
    lambda m: locate.grid_buckets(m.cells, locate.grid_of(m.cells, locate.LOCATOR)),
    f"SELECT ix, iy, iz, cell_id FROM (SELECT cell_id, {', '.join(f'unnest(range({_at(a + chr(109) + chr(105) + chr(110), a, n)}, {_at(a + chr(109) + chr(97) + chr(120), a, n)} + 1)) AS i{a}' if a == 'x' else f'{_at(a + chr(109) + chr(105) + chr(110), a, n)} AS {a}lo, {_at(a + chr(109) + chr(97) + chr(120), a, n)} AS {a}hi' for a, n in zip('xyz', (80, 80, 40), strict=True))} FROM cells, {_BOUNDS}), range(0, 80) AS ry(iy), range(0, 40) AS rz(iz) WHERE iy BETWEEN ylo AND yhi AND iz BETWEEN zlo AND zhi",
    "grid_buckets",
)
_on(
    lambda m: locate.grid_buckets(m.cells, locate.grid_of(m.cells, locate.LOCATOR), "centroid").groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n_cells"), F.min("cell_id").alias("first_cell")),
    f"SELECT {', '.join(f'{_at(chr(99) + a, a, n)} AS i{a}' for a, n in zip('xyz', (80, 80, 40), strict=True))}, count(*) AS n_cells, min(cell_id) AS first_cell FROM cells, {_BOUNDS} GROUP BY 1, 2, 3",
    "grid_buckets_centroid",
)

# --- aggregates ----------------------------------------------------------------
_STATS = f"step, var, count(value) AS count, min(value) AS min, max(value) AS max, {_r('avg(value)')} AS mean, {_r('stddev_pop(value)')} AS stddev"
_on(lambda m: rounded(fields.frame_statistics(m.cell_scalar)), f"SELECT {_STATS}, 'cell' AS position FROM cell_scalar GROUP BY 1, 2", "frame_statistics_cell")
_on(
    lambda m: rounded(fields.frame_statistics(m.cell_scalar, m.node_scalar)),
    f"SELECT {_STATS}, 'node' AS position FROM node_scalar GROUP BY 1, 2 UNION ALL SELECT {_STATS}, 'cell' AS position FROM cell_scalar WHERE var NOT IN (SELECT var FROM node_scalar) GROUP BY 1, 2",
    "frame_statistics_nodal_cell",
)
_on(
    lambda m: fields.nodal_extrema(m.node_source, m.node_source, m.node_scalar, "T"),
    "SELECT source_label, min(value) AS min, max(value) AS max FROM node_scalar JOIN node_source USING (node_id) WHERE var = 'T' GROUP BY 1",
    "point_extrema_nodal",
)
_on(
    lambda m: rounded(fields.projected_extrema(m.nodes.select((F.col("node_id") + 1).alias("point_id")), m.cell_nodes, m.cell_scalar, "P")),
    f"SELECT node_id + 1 AS point_id, {_r('min(v)')} AS min, {_r('max(v)')} AS max FROM (SELECT node_id, step, avg(value) AS v FROM cell_node JOIN cell_scalar USING (cell_id) WHERE var = 'P' GROUP BY 1, 2) GROUP BY 1",
    "point_extrema_projected",
)
_AGGREGATE = f"count(value) AS count, {_r('sum(value)', 4)} AS sum, {_r('avg(value)')} AS mean, min(value) AS min, max(value) AS max"
_on(
    lambda m: fields.selection_aggregate(m.cells.where(box_in_box(BOX_LOW, BOX_HIGH)), m.cell_scalar, "P", [STEP]).select("count", (F.round("sum", 4) + 0.0).alias("sum"), (F.round("mean", 7) + 0.0).alias("mean"), "min", "max"),
    f"SELECT {_AGGREGATE} FROM cell_scalar WHERE var = 'P' AND step = {STEP} AND cell_id IN (SELECT cell_id FROM cells WHERE {_MEMBER})",
    "selection_aggregate",
)
_on(lambda m: fields.value_range(m.cell_scalar), "SELECT step, var, min(value) AS min, max(value) AS max FROM cell_scalar GROUP BY 1, 2", "value_range")
_on(lambda m: fields.mesh_bounds(m.cells), "SELECT min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax, min(zmin) AS zmin, max(zmax) AS zmax, count(*) AS n_cells FROM cells", "mesh_bounds")
_on(lambda m: fields.mesh_bounds(m.cells, of_centroids=True), "SELECT min(cx) AS xmin, max(cx) AS xmax, min(cy) AS ymin, max(cy) AS ymax, min(cz) AS zmin, max(cz) AS zmax, count(*) AS n_cells FROM cells", "mesh_bounds_centroids")
_on(lambda m: fields.common_variables(m.cell_scalar), "SELECT var FROM cell_scalar GROUP BY var HAVING count(DISTINCT step) = (SELECT count(DISTINCT step) FROM cell_scalar)", "common_variables")
_DIFF = "SELECT step, var, max(abs(a.value - b.value)) AS d FROM cell_scalar a JOIN edges USING (cell_id) JOIN cell_scalar b USING (step, var) WHERE b.cell_id = neighbor_id GROUP BY 1, 2"
_on(lambda m: fields.max_neighbor_diff(m.edges, m.cell_scalar), f"SELECT step, var, coalesce(d, 0) AS max_diff FROM (SELECT DISTINCT step, var FROM cell_scalar) LEFT JOIN ({_DIFF}) USING (step, var)", "max_neighbor_diff")
_on(
    lambda m: fields.max_neighbor_diff(m.edges.where("cell_id < 0"), m.cell_scalar, "range"),
    "SELECT step, var, max(value) - min(value) AS max_diff FROM cell_scalar GROUP BY 1, 2",
    "max_neighbor_diff_range",
)
_on(
    lambda m: rounded(fields.node_projection(m.cell_nodes, fields.of(m.cell_scalar, step=STEP))),
    f"SELECT step, var, node_id, {_r('avg(value)')} AS value FROM cell_node JOIN cell_scalar USING (cell_id) WHERE step = {STEP} GROUP BY 1, 2, 3",
    "node_projection",
)
_on(
    lambda m: rounded(topology.nodal_to_cell(m.cell_nodes, fields.node_projection(m.cell_nodes, fields.of(m.cell_scalar, "U", STEP)))),
    f"SELECT step, var, cell_id, {_r('avg(value)')} AS value FROM cell_node JOIN (SELECT step, var, node_id, avg(value) AS value FROM cell_node JOIN cell_scalar USING (cell_id) WHERE var = 'U' AND step = {STEP} GROUP BY 1, 2, 3) USING (node_id) GROUP BY 1, 2, 3 HAVING count(*) = 8",
    "nodal_to_cell",
)
_on(
    lambda m: fields.of(m.cell_scalar, step=STEP).select("var").distinct().intersect(m.node_scalar.select("var").distinct()),
    f"SELECT DISTINCT var FROM cell_scalar WHERE step = {STEP} INTERSECT SELECT DISTINCT var FROM node_scalar",
    "shared_variables",
)

# --- topology ------------------------------------------------------------------
_on(
    lambda m: topology.cells_from_nodes(m.cell_nodes, m.nodes).select(*m.cells.columns),
    "SELECT * FROM cells",
    "cells_from_nodes",
)
_on(
    lambda m: topology.adjacency_by_nodes(m.cell_nodes.withColumn("element_type", F.lit("C3D8"))),
    "SELECT a.cell_id AS cell_id, b.cell_id AS neighbor_id FROM cell_node a JOIN cell_node b USING (node_id) WHERE a.cell_id <> b.cell_id GROUP BY 1, 2 HAVING count(*) >= 3",
    "adjacency_by_nodes",
)


def lattice_faces(m: Mesh) -> DataFrame:
    """Faces of the lattice with ordered nodes, owners left and right."""
    corner = lambda *k: F.array(*(F.get("node_ids", F.lit(i)) for i in k))
    rings = [(1, (1, 3, 7, 5)), (20, (2, 3, 7, 6)), (200, (4, 5, 7, 6))]
    lows = [(0, 2, 6, 4), (0, 1, 5, 4), (0, 1, 3, 2)]
    sided = lambda keys: F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("d"), corner(*k).alias("node_ids")) for (d, _), k in zip(rings, keys, strict=True))))
    upper = m.cell_nodes.select(F.col("cell_id").alias("left"), sided([r for _, r in rings]).alias("f")).select("left", "f.d", "f.node_ids")
    ahead = m.edges.where("neighbor_id > cell_id").select(F.col("cell_id").alias("left"), (F.col("neighbor_id") - F.col("cell_id")).alias("d"), F.col("neighbor_id").alias("right"))
    right = upper.join(ahead, ["left", "d"], "left").select("left", F.coalesce("right", F.lit(-1)).alias("right"), "d", "node_ids")
    lower = m.cell_nodes.select(F.col("cell_id").alias("right"), sided(lows).alias("f")).select("right", "f.d", "f.node_ids")
    back = m.edges.where("neighbor_id < cell_id").select(F.col("cell_id").alias("right"), (F.col("cell_id") - F.col("neighbor_id")).alias("d"))
    open_ = lower.join(back, ["right", "d"], "left_anti").select(F.lit(-1).cast("long").alias("left"), "right", "d", "node_ids")
    every = right.unionByName(open_)
    return every.select((F.greatest("left", "right") * 1000 + F.col("d") * 2 + F.when(F.col("left") < 0, 1).otherwise(0)).alias("face_id"), "node_ids", "left", "right")


_on(
    lambda m: topology.elements_from_faces(lattice_faces(m)).select("cell_id", F.explode("node_ids").alias("node_id")),
    "SELECT cell_id, node_id FROM cell_node",
    "elements_from_faces",
)
_on(lambda m: topology.adjacency_from_faces(lattice_faces(m)), "SELECT cell_id, neighbor_id FROM edges", "adjacency_from_faces")
_on(
    lambda m: rounded(topology.boundary_faces(lattice_faces(m), m.nodes, m.cells).select("cell_id", "nx", "ny", "nz", "area", "cx", "cy", "cz")),
    "SELECT cell_id, nx, ny, nz, CAST(1 AS DOUBLE) AS area, cx, cy, cz FROM boundary_faces",
    "boundary_faces_from_faces",
)
_on(
    lambda m: rounded(topology.face_planes(lattice_faces(m), m.nodes, m.cells)),
    "SELECT e.cell_id, e.neighbor_id, b.cx - a.cx AS nx, b.cy - a.cy AS ny, b.cz - a.cz AS nz, -((b.cx - a.cx) * (a.cx + b.cx) + (b.cy - a.cy) * (a.cy + b.cy) + (b.cz - a.cz) * (a.cz + b.cz)) / 2 AS d FROM edges e JOIN cells a ON a.cell_id = e.cell_id JOIN cells b ON b.cell_id = e.neighbor_id",
    "face_planes",
)
_on(
    lambda m: topology.cell_shells(m).groupBy("cell_id").agg(F.count(F.lit(1)).alias("triangles")),
    "SELECT cell_id, CAST(12 AS BIGINT) AS triangles FROM cells",
    "cell_shells",
)

# --- surfaces ------------------------------------------------------------------
_NORMALS = """
sums AS (SELECT cell_id, sum(nx * area) / sum(area) AS mx, sum(ny * area) / sum(area) AS my, sum(nz * area) / sum(area) AS mz FROM boundary_faces GROUP BY 1),
normals AS (SELECT cell_id, CASE WHEN s > 1e-15 THEN mx / s ELSE 1 END AS nx, CASE WHEN s > 1e-15 THEN my / s ELSE 0 END AS ny, CASE WHEN s > 1e-15 THEN mz / s ELSE 0 END AS nz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS s FROM sums))"""


def _with(extra: str, sql: str) -> str:
    """``sql`` with more CTEs put before its last SELECT."""
    return f",{extra}\n{sql}"


_on(lambda m: rounded(surface.boundary_normals(m.boundary_faces)), None, "boundary_normals")
ORACLE["boundary_normals"] = with_lattice("").rstrip() + _with(_NORMALS, f"SELECT cell_id, {_r('nx')} AS nx, {_r('ny')} AS ny, {_r('nz')} AS nz FROM normals")
_on(lambda m: rounded(surface.surface_force(surface.surface_cells_and_normals(m), m.cell_scalar, "P"), 4), None, "surface_force")
ORACLE["surface_force"] = with_lattice("").rstrip() + _with(_NORMALS, f"SELECT step, {_r('sum(value * nx)', 4)} AS fx, {_r('sum(value * ny)', 4)} AS fy, {_r('sum(value * nz)', 4)} AS fz FROM normals JOIN cell_scalar USING (cell_id) WHERE var = 'P' GROUP BY 1")
_on(lambda m: rounded(surface.surface_normals(m)), "SELECT cell_id, 0.0 AS nx, 0.0 AS ny, -1.0 AS nz FROM cells", "surface_normals")
ORACLE["surface_normals"] = ORACLE["surface_normals"].replace("0.0 AS nx, 0.0 AS ny, -1.0 AS nz", "CAST(0 AS DOUBLE) AS nx, CAST(0 AS DOUBLE) AS ny, CAST(1 AS DOUBLE) AS nz")
_on(lambda m: rounded(surface.fallback_normals(m)), "SELECT cell_id, CAST(0 AS DOUBLE) AS nx, CAST(0 AS DOUBLE) AS ny, CAST(1 AS DOUBLE) AS nz FROM cells", "fallback_normals")
_SELECTED = f"SELECT cell_id FROM cell_scalar WHERE var = 'P' AND step = {STEP} AND value BETWEEN 60000 AND 80000"
_on(
    lambda m: surface.extract_submesh(m, fields.range_var(m.cell_scalar, "P", 60000.0, 80000.0, STEP))["nodes"],
    f"SELECT * FROM nodes WHERE node_id IN (SELECT node_id FROM cell_node WHERE cell_id IN ({_SELECTED}))",
    "submesh_nodes",
)
_on(
    lambda m: surface.extract_submesh(m, fields.range_var(m.cell_scalar, "P", 60000.0, 80000.0, STEP))["cells"],
    f"SELECT * FROM cells WHERE cell_id IN ({_SELECTED})",
    "submesh_cells",
)


def _iso_sql() -> str:
    edges = " UNION ALL ".join(
        f"SELECT cell_id, tet, {k} AS k, " + ", ".join(f"{c}{a} + greatest(least((60000 - v{a}) / (v{b} - v{a}), 1), 0) * ({c}{b} - {c}{a}) AS {c}" for c in "xyz") + f" FROM tets WHERE (v{a} - 60000) * (v{b} - 60000) < 0"
        for k, (a, b) in enumerate(surface.TET_EDGES)
    )
    corner = ", ".join(f"{c}.{f} AS {f2}{k}" for k, c in enumerate("abcd") for f, f2 in (("x", "x"), ("y", "y"), ("z", "z"), ("v", "v")))
    return f""",
proj AS (SELECT node_id, avg(value) AS v FROM cell_node JOIN cell_scalar USING (cell_id) WHERE var = 'P' AND step = {STEP} GROUP BY 1),
corner AS (SELECT cell_id, k, x, y, z, v FROM cell_node JOIN nodes USING (node_id) JOIN proj USING (node_id)),
tets AS (SELECT a.cell_id AS cell_id, t AS tet, {corner} FROM range(1, 6) AS r(t), corner a, corner b, corner c, corner d WHERE a.cell_id = b.cell_id AND a.cell_id = c.cell_id AND a.cell_id = d.cell_id AND a.k = 0 AND b.k = t AND c.k = t + 1 AND d.k = t + 2),
hits AS ({edges}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id, tet ORDER BY k) AS n, count(*) OVER (PARTITION BY cell_id, tet) AS m FROM hits)
SELECT cell_id, CAST(tet AS INTEGER) AS tet, {', '.join(f"{_r(f'max(CASE WHEN n = {i + 1} THEN {c} END)')} AS {n}{c}" for i, n in enumerate('abc') for c in 'xyz')} FROM ranked WHERE m >= 3 GROUP BY 1, 2"""


_on(lambda m: rounded(surface.isosurface(m, "P", 60000.0, STEP)), None, "isosurface_projected")
ORACLE["isosurface_projected"] = with_lattice("").rstrip() + _iso_sql()
_on(lambda m: surface.isosurface(m, "P", 60000.0, STEP, node_values="cell").select("cell_id", "tet"), "SELECT cell_id, CAST(0 AS INTEGER) AS tet FROM cells WHERE false", "isosurface_cell")

# --- gradients -------------------------------------------------------------------
_DET = "sxx * (syy * szz - syz * syz) + sxy * (sxz * syz - sxy * szz) + sxz * (sxy * syz - sxz * syy)"


def _solve(v: str) -> str:
    co = [["syy * szz - syz * syz", "sxz * syz - sxy * szz", "sxy * syz - sxz * syy"], ["sxz * syz - sxy * szz", "sxx * szz - sxz * sxz", "sxy * sxz - sxx * syz"], ["sxy * syz - sxz * syy", "sxy * sxz - sxx * syz", "sxx * syy - sxy * sxy"]]
    return ", ".join("(" + " + ".join(f"({co[i][j]}) * r{v}{a}" for j, a in enumerate("xyz")) + f") / det AS g{v}{c}" for i, c in enumerate("xyz"))


_GRADIENT = f""",
moving AS (SELECT cell_id, cx, cy, cz, U, V, W FROM cells JOIN scalar_wide USING (cell_id) WHERE step = {STEP}),
diffs AS (SELECT a.cell_id AS cell_id, b.cx - a.cx AS dx, b.cy - a.cy AS dy, b.cz - a.cz AS dz, b.U - a.U AS du, b.V - a.V AS dv, b.W - a.W AS dw FROM moving a JOIN edges e ON a.cell_id = e.cell_id JOIN moving b ON b.cell_id = e.neighbor_id),
sums AS (SELECT cell_id, count(*) AS n, {', '.join(f'sum(d{a} * d{b}) AS s{a}{b}' for a, b in gradient._PAIRS)}, {', '.join(f'sum(d{v} * d{a}) AS r{v}{a}' for v in 'uvw' for a in 'xyz')} FROM diffs GROUP BY 1),
solved AS (SELECT cell_id, n, {_solve('u')}, {_solve('v')}, {_solve('w')} FROM (SELECT *, {_DET} AS det FROM sums WHERE n >= 3) WHERE abs(det) > 1e-9),
q AS (SELECT cell_id, -0.5 * (gux * gux + gvy * gvy + gwz * gwz) - (guy * gvx + guz * gwx + gvz * gwy) AS q FROM solved WHERE cell_id IN (SELECT cell_id FROM cells WHERE {_MEMBER}))
"""
_on(lambda m: rounded(gradient.gradients(m, STEP, deficient="drop"), 9), None, "gradient")
ORACLE["gradient"] = with_lattice("").rstrip() + _GRADIENT + f"SELECT cell_id, n, {', '.join(f'{_r(g, 9)} AS {g}' for g in gradient.G)} FROM solved"
_on(lambda m: rounded(gradient.q_criterion(m, BOX_LOW, BOX_HIGH, STEP, deficient="drop"), 9), None, "qcriterion_roi")
ORACLE["qcriterion_roi"] = with_lattice("").rstrip() + _GRADIENT + f"SELECT cell_id, {_r('q', 9)} AS q FROM q"
_on(lambda m: rounded(gradient.vortex_cells(m, BOX_LOW, BOX_HIGH, STEP, -40.0, deficient="drop"), 9), None, "vortex_cells")
ORACLE["vortex_cells"] = with_lattice("").rstrip() + _GRADIENT + f"SELECT cell_id, {_r('q', 9)} AS q FROM q WHERE q >= -40"

# --- traces, interpolation ----------------------------------------------------------
_FLOOR = " AND ".join(f"n{a} >= {a}min AND n{a} <= {a}max" for a in "xyz")


@query()
def advect_w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = lattice_mesh(spark, sf_dir)
    return rounded(trace.advect(probe_points(spark, sf_dir), mesh, list(range(1, 8))))


def _advect_sql() -> str:
    """The steps unrolled; a point's cell is the nearest box centre, then the smaller id."""
    at = "SELECT point_id, 0 AS moves, x, y, z, arg_min(cell_id, ({d}) * 1e6 + cell_id * 1e-9) AS cell_id FROM points, cells WHERE {i} GROUP BY 1, 2, 3, 4, 5"
    parts = [f"a0 AS MATERIALIZED ({at.format(d=_DISTANCE, i=_INSIDE)})"]
    for k in range(1, 8):
        parts.append(
            f"m{k} AS MATERIALIZED (SELECT point_id, x + U * CAST(0.01 AS DOUBLE) AS x, y + V * CAST(0.01 AS DOUBLE) AS y, z + W * CAST(0.01 AS DOUBLE) AS z FROM a{k - 1} JOIN scalar_wide USING (cell_id) WHERE step = {k} AND moves = {k - 1})"
        )
        parts.append(f"h{k} AS MATERIALIZED (SELECT point_id, x, y, z, arg_min(cell_id, ({_DISTANCE}) * 1e6 + cell_id * 1e-9) AS cell_id FROM m{k}, cells WHERE {_INSIDE} GROUP BY 1, 2, 3, 4)")
        parts.append(f"a{k} AS MATERIALIZED (SELECT a.point_id AS point_id, CASE WHEN h.cell_id IS NULL THEN a.moves ELSE a.moves + 1 END AS moves, coalesce(h.x, a.x) AS x, coalesce(h.y, a.y) AS y, coalesce(h.z, a.z) AS z, coalesce(h.cell_id, a.cell_id) AS cell_id FROM a{k - 1} a LEFT JOIN h{k} h ON a.point_id = h.point_id)")
    return ",\n" + ",\n".join(parts) + f"\nSELECT point_id, moves, {', '.join(f'{_r(c)} AS {c}' for c in 'xyz')}, cell_id FROM a7"


ORACLE["advect_w4"] = with_lattice("").rstrip() + _advect_sql()


@query()
def streamline_w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = lattice_mesh(spark, sf_dir)
    return rounded(trace.streamlines(probe_points(spark, sf_dir), mesh, STEP, dt=0.05))


def _affine(m: Mesh) -> DataFrame:
    """A nodal field 4 + x + 2 y + 3 z, which interpolation reproduces."""
    return m.nodes.select(F.lit(STEP).alias("step"), F.lit("A").alias("var"), "node_id", (F.lit(4.0) + F.col("x") + 2 * F.col("y") + 3 * F.col("z")).alias("value"))


@query(f"SELECT point_id, CASE WHEN hit THEN 0 ELSE 1 END AS status, CASE WHEN hit THEN {_r('4 + x + 2 * y + 3 * z')} END AS A FROM (SELECT point_id, x, y, z, x >= x0 - 2e-9 AND x <= x1 + 2e-9 AND y >= y0 - 2e-9 AND y <= y1 + 2e-9 AND z >= z0 - 2e-9 AND z <= z1 + 2e-9 AS hit FROM points, {_BOUNDS})")
def couple_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = lattice_mesh(spark, sf_dir)
    out = interpolate.couple(probe_points(spark, sf_dir), mesh, ["A"], STEP, node_values=_affine(mesh))
    return rounded(out.select("point_id", "status", "A"))


@query()
def couple(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = lattice_mesh(spark, sf_dir)
    return rounded(interpolate.couple(probe_points(spark, sf_dir), mesh, ["P", "U"], STEP).select("point_id", "status", "cell_id", "error", "P", "U"))
