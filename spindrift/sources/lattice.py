"""A hexahedral lattice derived from the driver's tables, the mesh of the registered queries.

Parts are cells of a 20 x 10 x k lattice of unit boxes; line items are frames of
cell scalars (step = line number) and of nodal scalars; events are probe points.
``SQL`` states the same tables for DuckDB.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.topology import cells_from_nodes
from spindrift.sources.model import Mesh

NX, NY = 20, 10
CORNERS = [(dx, dy, dz) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)]
SIDES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
#: variable -> (aggregate, line item column)
FIELDS = {"U": ("max", "l_quantity"), "V": ("max", "l_discount"), "W": ("max", "l_tax"), "P": ("max", "l_extendedprice"), "K": ("min", "l_quantity"), "E": ("min", "l_extendedprice")}
NODE_FIELDS = {"T": ("max", "l_extendedprice"), "P": ("max", "l_quantity")}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_partkey").cast("long")
    at = [c % NX, F.floor(c / float(NX)) % NY, F.floor(c / float(NX * NY))]
    i = [F.col(n) for n in ("ix", "iy", "iz")]
    placed = _table(spark, sf_dir, "part").select(c.alias("cell_id"), *(v.cast("long").alias(n) for v, n in zip(at, ("ix", "iy", "iz"), strict=True)))
    low = {a: v.cast("double") for a, v in zip("xyz", i, strict=True)}
    return placed.select("cell_id", "ix", "iy", "iz", *((low[a] + 0.5).alias(f"c{a}") for a in "xyz"), *(e for a in "xyz" for e in (low[a].alias(f"{a}min"), (low[a] + 1.0).alias(f"{a}max"))))


def _long(source: DataFrame, fields: dict, entity: str, name: str) -> DataFrame:
    """Long scalars; one aggregation for all variables."""
    made = source.groupBy(F.col("l_linenumber").cast("int").alias("step"), F.col(entity).cast("long").alias(name)).agg(*(getattr(F, f)(c).alias(v) for v, (f, c) in fields.items()))
    return made.unpivot(["step", name], list(fields), "var", "value").select("step", "var", name, "value")


def lattice_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    cells = lattice_cells(spark, sf_dir)
    node = lambda d: (F.col("ix") + d[0]) + (NX + 1) * ((F.col("iy") + d[1]) + (NY + 1) * (F.col("iz") + d[2]))
    cell_nodes = cells.select("cell_id", F.array(*(node(d) for d in CORNERS)).alias("node_ids"))
    n = F.col("node_id")
    nodes = cell_nodes.select(F.explode("node_ids").alias("node_id")).distinct().select(
        "node_id", (n % (NX + 1)).cast("double").alias("x"), (F.floor(n / float(NX + 1)) % (NY + 1)).cast("double").alias("y"), F.floor(n / float((NX + 1) * (NY + 1))).cast("double").alias("z")
    )
    last = cells.agg(F.max("cell_id").alias("last"))
    beside = [
        F.when((F.col("ix") + dx).between(0, NX - 1) & (F.col("iy") + dy).between(0, NY - 1) & (F.col("iz") + dz >= 0), F.col("cell_id") + dx + NX * dy + NX * NY * dz) for dx, dy, dz in SIDES
    ]
    reach = cells.select("cell_id", F.explode(F.array(*beside)).alias("neighbor_id")).where("neighbor_id IS NOT NULL")
    edges = reach.join(F.broadcast(last), F.col("neighbor_id") <= F.col("last")).select("cell_id", "neighbor_id")  # one row
    lines = _table(spark, sf_dir, "lineitem")
    return Mesh.of(
        spark,
        cells=cells.drop("ix", "iy", "iz"),
        nodes=nodes,
        cell_nodes=cell_nodes,
        edges=edges,
        boundary_faces=_boundary(cells, last),
        cell_source=cells.select("cell_id", (F.col("cell_id") + 5000).alias("source_label")),
        node_source=nodes.select("node_id", (F.col("node_id") + 1000).alias("source_label")),
        cell_scalar=_long(lines, FIELDS, "l_partkey", "cell_id"),
        node_scalar=_long(lines, NODE_FIELDS, "l_suppkey", "node_id"),
        meta={"dataset": "lattice", "zone": "0_Fluid"},
    )


#: The ways from a box's low corner to its high one, an axis at a time; each spans a tetrahedron.
WAYS = tuple(itertools.permutations("xyz"))
#: Slant of the tetrahedral mesh: x grows by this with z, y with the grown x.
SLANT = (0.3, 0.25)


def tetra_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """The lattice with each box cut into six tetrahedra along its diagonal, then slanted; no box fits its cell.

    Cell ids are 6 * box + k of ``WAYS``; nodes and frames are the lattice's.
    """
    lattice = lattice_mesh(spark, sf_dir)
    bit = {"x": 1, "y": 2, "z": 4}  # corner numbers of CORNERS
    paths = [(0, bit[a], bit[a] + bit[b], 7) for a, b, _ in WAYS]
    tets = F.posexplode(F.array(*(F.array(*(F.get("node_ids", F.lit(c)) for c in path)) for path in paths))).alias("k", "node_ids")
    cell_nodes = lattice.cell_nodes.select("cell_id", tets).select((F.col("cell_id") * 6 + F.col("k")).alias("cell_id"), "node_ids")
    x = F.col("x") + SLANT[0] * F.col("z")
    nodes = lattice.nodes.select("node_id", x.alias("x"), (F.col("y") + SLANT[1] * x).alias("y"), "z")
    frames = lattice.cell_scalar.select("step", "var", F.explode(F.array(*(F.col("cell_id") * 6 + k for k in range(6)))).alias("cell_id"), "value")
    return Mesh.of(spark, cells=cells_from_nodes(cell_nodes, nodes), nodes=nodes, cell_nodes=cell_nodes, cell_scalar=frames, meta={"dataset": "tetra", "zone": "0_Fluid"})


def _boundary(cells: DataFrame, last: DataFrame) -> DataFrame:
    """Outer faces with outward axis normals; areas vary by cell so that weighting shows."""
    at, top = [F.col("ix"), F.col("iy"), F.col("iz")], [F.lit(NX - 1), F.lit(NY - 1), F.floor(F.col("last") / float(NX * NY))]
    sides: list[Column] = []
    for k, d in enumerate(SIDES):
        axis = next(i for i in range(3) if d[i])
        outer = at[axis] == (top[axis] if d[axis] > 0 else F.lit(0))
        centre = [F.col(f"c{a}") + 0.5 * d[i] for i, a in enumerate("xyz")]
        face = F.struct(
            (F.col("cell_id") * 6 + k).alias("face_id"), F.lit("hull" if axis == 2 else "wall").alias("patch"), *(F.lit(float(d[i])).alias(f"n{a}") for i, a in enumerate("xyz")),
            (F.lit(1.0) + F.col("cell_id") % 3).cast("double").alias("area"), *(c.alias(f"f{a}") for c, a in zip(centre, "xyz", strict=True)),
        )
        sides.append(F.when(outer, face))
    faces = cells.join(F.broadcast(last)).select("cell_id", F.explode(F.array(*sides)).alias("f")).where("f IS NOT NULL")
    return faces.select("f.face_id", "cell_id", "f.patch", "f.nx", "f.ny", "f.nz", "f.area", F.col("f.fx").alias("cx"), F.col("f.fy").alias("cy"), F.col("f.fz").alias("cz"))


def probe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, z) from events all over the lattice, some outside, some on faces."""
    e, layers = F.col("event_id"), -(-_table(spark, sf_dir, "part").count() // (NX * NY))
    at = lambda k, n: (e * k % n).cast("double") / 100.0 - 0.5
    return _table(spark, sf_dir, "events").select(e.cast("long").alias("point_id"), at(37, 2100).alias("x"), at(53, 1100).alias("y"), at(71, 100 * layers + 150).alias("z"))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"


def _unpivoted(wide: str, name: str, fields: dict) -> str:
    return " UNION ALL ".join(f"SELECT step, '{v}' AS var, {name}, {v} AS value FROM {wide}" for v in fields)


def _wide(entity: str, name: str, fields: dict) -> str:
    aggs = ", ".join(f"{f}({c}) AS {v}" for v, (f, c) in fields.items())
    return f"SELECT CAST(l_linenumber AS INTEGER) AS step, CAST({entity} AS BIGINT) AS {name}, {aggs} FROM lineitem GROUP BY 1, 2"


def _face_sql() -> str:
    rows = []
    for k, d in enumerate(SIDES):
        axis = next(i for i in range(3) if d[i])
        rows.append((k, *d, axis, "'hull'" if axis == 2 else "'wall'"))
    return f"""
SELECT cell_id * 6 + k AS face_id, cell_id, patch, CAST(dx AS DOUBLE) AS nx, CAST(dy AS DOUBLE) AS ny, CAST(dz AS DOUBLE) AS nz,
       CAST(1 + cell_id % 3 AS DOUBLE) AS area, cx + 0.5 * dx AS cx, cy + 0.5 * dy AS cy, cz + 0.5 * dz AS cz
FROM c0, {_values(rows)} AS s(k, dx, dy, dz, axis, patch)
WHERE CASE axis WHEN 0 THEN ix WHEN 1 THEN iy ELSE iz END =
      CASE WHEN dx + dy + dz < 0 THEN 0 WHEN axis = 0 THEN {NX - 1} WHEN axis = 1 THEN {NY - 1} ELSE (SELECT max(iz) FROM c0) END"""


#: CTEs of the lattice for DuckDB; queries follow after "WITH " + SQL.
SQL = f"""
c0 AS (SELECT CAST(p_partkey AS BIGINT) AS cell_id, CAST(p_partkey % {NX} AS BIGINT) AS ix, CAST(floor(p_partkey / {NX}.0) AS BIGINT) % {NY} AS iy, CAST(floor(p_partkey / {NX * NY}.0) AS BIGINT) AS iz,
              CAST(p_partkey % {NX} AS DOUBLE) + 0.5 AS cx, CAST(CAST(floor(p_partkey / {NX}.0) AS BIGINT) % {NY} AS DOUBLE) + 0.5 AS cy, CAST(floor(p_partkey / {NX * NY}.0) AS DOUBLE) + 0.5 AS cz FROM part),
cells AS (SELECT cell_id, cx, cy, cz, cx - 0.5 AS xmin, cx + 0.5 AS xmax, cy - 0.5 AS ymin, cy + 0.5 AS ymax, cz - 0.5 AS zmin, cz + 0.5 AS zmax FROM c0),
cell_node AS (SELECT cell_id, k, ix + dx + {NX + 1} * (iy + dy + {NY + 1} * (iz + dz)) AS node_id FROM c0, {_values([(k, *d) for k, d in enumerate(CORNERS)])} AS o(k, dx, dy, dz)),
nodes AS (SELECT node_id, CAST(node_id % {NX + 1} AS DOUBLE) AS x, CAST(CAST(floor(node_id / {NX + 1}.0) AS BIGINT) % {NY + 1} AS DOUBLE) AS y, CAST(floor(node_id / {(NX + 1) * (NY + 1)}.0) AS DOUBLE) AS z FROM (SELECT DISTINCT node_id FROM cell_node)),
edges AS (SELECT a.cell_id, b.cell_id AS neighbor_id FROM c0 a, {_values(SIDES)} AS o(dx, dy, dz), c0 b WHERE b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz),
scalar_wide AS ({_wide("l_partkey", "cell_id", FIELDS)}),
cell_scalar AS ({_unpivoted("scalar_wide", "cell_id", FIELDS)}),
node_wide AS ({_wide("l_suppkey", "node_id", NODE_FIELDS)}),
node_scalar AS ({_unpivoted("node_wide", "node_id", NODE_FIELDS)}),
boundary_faces AS ({_face_sql()}),
cell_source AS (SELECT cell_id, cell_id + 5000 AS source_label FROM cells),
node_source AS (SELECT node_id, node_id + 1000 AS source_label FROM nodes),
points AS (SELECT CAST(event_id AS BIGINT) AS point_id, CAST(event_id * 37 % 2100 AS DOUBLE) / CAST(100 AS DOUBLE) - 0.5 AS x, CAST(event_id * 53 % 1100 AS DOUBLE) / CAST(100 AS DOUBLE) - 0.5 AS y, CAST(event_id * 71 % (SELECT CAST(100 * ceil(count(*) / {NX * NY}.0) + 150 AS BIGINT) FROM part) AS DOUBLE) / CAST(100 AS DOUBLE) - 0.5 AS z FROM events)"""


def with_lattice(query: str) -> str:
    return f"WITH {SQL.strip()}\n{query.strip()}"
