"""The workloads with fixed inputs as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import fields, surface
from spindrift.plans import workloads
from spindrift.plans.queries import _CENTRED, _INSIDE, _MEMBER, _SIZE, _STATS, BOX_HIGH, BOX_LOW, ORACLE, PLANE, SEGMENT, STEP, _DISTANCE, _iso_sql, _r, _slabs, query, rounded
from spindrift.plans.session import MeshSession
from spindrift.sources.lattice import lattice_mesh, probe_points, with_lattice

_P = f"(SELECT cell_id, value FROM cell_scalar WHERE var = 'P' AND step = {STEP})"
_REDUCED = f"count(value) AS count, {_r('sum(value)', 4)} AS sum, {_r('avg(value)', 8)} AS mean, max(value) AS max, min(value) AS min"


def _session(spark: SparkSession, sf_dir: str) -> MeshSession:
    return MeshSession(lattice_mesh(spark, sf_dir), STEP, "lattice")


def _short(df: DataFrame) -> DataFrame:
    return df.select("count", (F.round("sum", 4) + 0.0).alias("sum"), (F.round("mean", 8) + 0.0).alias("mean"), "max", "min")


@query(f"SELECT {_REDUCED} FROM (SELECT point_id, arg_min(cell_id, ({_DISTANCE}) * 1e6 + cell_id * 1e-9) AS cell_id FROM points, cells WHERE {_INSIDE} GROUP BY 1) JOIN {_P} USING (cell_id)")
def w1_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    return _short(workloads.reduced(s.point_intersection(probe_points(spark, sf_dir)), s, "P", STEP))


@query(f"SELECT {_REDUCED} FROM (SELECT cell_id, CAST({_slabs()[0]} AS DOUBLE) AS t, CAST({_slabs()[1]} AS DOUBLE) AS u FROM cells) JOIN {_P} USING (cell_id) WHERE t <= u + 1e-9")
def w1_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    return _short(workloads.reduced(s.line_intersection(*SEGMENT), s, "P", STEP))


@query(f"SELECT {_REDUCED} FROM cells JOIN {_P} USING (cell_id) WHERE abs(((cx - 5.3) * 1.0 + cy * 0.3 + cz * -0.2) / {_SIZE}) <= 0.5 * (1.0 + 0.3 + 0.2) / {_SIZE} + 1e-9")
def w1_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    return _short(workloads.reduced(s.plane_intersection(*PLANE), s, "P", STEP))


@query(f"SELECT {_REDUCED} FROM cell_scalar JOIN cells USING (cell_id) WHERE var = 'P' AND {_MEMBER}")
def w2_box_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(workloads.box_aggregate(_session(spark, sf_dir), BOX_LOW, BOX_HIGH, "P"))


#: The cell whose value seeds W3.
SEED_CELL = 100


@query()
def w3_seeded_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(workloads.seeded_surface(_session(spark, sf_dir), SEED_CELL, "P", STEP))


def _seeded_sql() -> str:
    """The surface's SQL at the seed's value, through cells within the largest neighbour difference of it."""
    spread = f"SELECT max(abs(a.value - b.value)) FROM {_P} a JOIN edges USING (cell_id) JOIN {_P} b ON b.cell_id = neighbor_id"
    seed = f"seed AS (SELECT value AS iso, value - ({spread}) AS low, value + ({spread}) AS high FROM {_P} WHERE cell_id = {SEED_CELL})"
    sql = _iso_sql().replace("60000", "iso").replace("FROM tets WHERE", "FROM tets, seed WHERE")
    sql = sql.replace("WHERE m >= 3", f"WHERE m >= 3 AND cell_id IN (SELECT cell_id FROM {_P}, seed WHERE value BETWEEN low AND high)")
    return with_lattice("").rstrip() + f",\n{seed}" + sql


ORACLE["w3_seeded_surface"] = _seeded_sql()


@query()
def w6_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    return rounded(surface.surface_force(s.surface_cells_and_normals(), s.mesh.cell_scalar, s.resolve_w6_scalar(("none", "P")), STEP), 4)


ORACLE["w6_force"] = ORACLE["surface_force"].replace("WHERE var = 'P'", f"WHERE var = 'P' AND step = {STEP}")


@query()
def w7_qcriterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_session(spark, sf_dir).compute_qcriterion_roi(BOX_HIGH, BOX_LOW, deficient="drop"), 9)


ORACLE["w7_qcriterion"] = ORACLE["qcriterion_roi"]


@query(f"SELECT cell_id + 1 AS element_id FROM cells WHERE {_CENTRED}")
def w9_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).cfd_element_ids_in_coordinate_range(BOX_LOW, BOX_HIGH)


@query(f"SELECT cell_id FROM {_P}, (SELECT min(value) AS lo, max(value) AS hi FROM {_P}) WHERE value BETWEEN lo + 0.25 * (hi - lo) AND lo + 0.75 * (hi - lo)")
def w8_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    lo, hi = s.var_value_range("P")
    return s.range_query_var(lo + 0.25 * (hi - lo), lo + 0.75 * (hi - lo), "P")


@query(f"SELECT {_STATS}, 'cell' AS position FROM cell_scalar WHERE step = {STEP} GROUP BY 1, 2")
def w10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_session(spark, sf_dir).cfd_frame_statistics(step=STEP))


@query(f"SELECT node_id + 1 AS point_id, {_r('min(v)')} AS min, {_r('max(v)')} AS max FROM (SELECT node_id, step, avg(value) AS v FROM cell_node JOIN cell_scalar USING (cell_id) WHERE var = 'U' GROUP BY 1, 2) GROUP BY 1")
def w11_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = lattice_mesh(spark, sf_dir)
    ids = mesh.nodes.select((F.col("node_id") + 1).alias("point_id"))
    return rounded(fields.projected_extrema(ids, mesh.cell_nodes, mesh.cell_scalar, "U"))


@query("SELECT 'lattice' AS dataset, '0_Fluid' AS zone, list_aggregate(list_sort(list(DISTINCT CAST(step AS VARCHAR))), 'string_agg', ',') AS steps, 'E,K,P,U,V,W' AS variables FROM cell_scalar")
def discover_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.sources.model import discover

    named = lattice_mesh(spark, sf_dir).cell_scalar.withColumn("dataset", F.lit("lattice")).withColumn("zone", F.lit("0_Fluid"))
    return discover(named).select("dataset", "zone", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), F.array_join("variables", ",").alias("variables"))


#: A mesh of two tetrahedra and a square hull, as a Tecplot file of two zones.
TWO_ZONES = """TITLE ="two tetrahedra"
VARIABLES ="X" "Y" "Z" "U" "V" "W" "P" "K" "E"
ZONE  T="0_Fluid"
N =5, E =2
 Nodes =5, Faces=7, Elements =2, ZONETYPE=FEPolyhedron
 DATAPACKING=BLOCK
 DT=(DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE)
0 1 0 0 0
0 0 1 0 0
0 0 0 1 -1
{u}
3 4
5 6
{p}
9 10
11 12
# node count per face
3 3 3 3 3 3 3
# face nodes
1 2 3   1 4 2   2 4 3   3 4 1   1 2 5   2 3 5   3 1 5
# left elements
1 1 1 1 2 2 2
# right elements
2 0 0 0 0 0 0
ZONE T="0_Wall_hull"
N=4,E=1
Nodes=4,Faces=4,Elements=1,ZONETYPE=FEPolygon
DATAPACKING=BLOCK
DT=(DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE)
0 1 1 0
0 0 1 1
0 0 0 0
0.0
0.0
0.0
42.0
0.0
0.0
# face nodes
1 2  2 3  3 4  4 1
# left elements
1 1 1 1
# right elements
0 0 0 0
"""


def _tecplot_folder(spark: SparkSession) -> str:
    """The fixture as two frames in the shared folder, which every executor can read."""
    from spindrift.functions.storage import shared_dir

    at = f"{shared_dir(spark)}/tecplot-fixture"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, u, p in (("200_case.dat", "1 2", "7 8"), ("400_case.dat", "2 4", "9 10")):
        out = fs.create(fs_path(f"{at}/{name}"), True)
        out.write(bytearray(TWO_ZONES.format(u=u, p=p).encode()))
        out.close()
    return at


@query("SELECT * FROM (VALUES (0, 0.25, 0.25, 0.25, 0.0, 1.0, 4, 1), (1, 0.25, 0.25, -0.25, -1.0, 0.0, 4, 1)) AS t(cell_id, cx, cy, cz, zmin, zmax, n_nodes, n_neighbors)")
def tecplot_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.sources.tecplot import read_tecplot

    mesh = read_tecplot(spark, _tecplot_folder(spark), "0_Fluid")
    near = mesh.edges.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_neighbors"))
    out = mesh.cells.join(mesh.cell_nodes.select("cell_id", F.size("node_ids").alias("n_nodes")), "cell_id").join(near, "cell_id")
    return out.select(F.col("cell_id").cast("int").alias("cell_id"), "cx", "cy", "cz", "zmin", "zmax", F.col("n_nodes").cast("int").alias("n_nodes"), F.col("n_neighbors").cast("int").alias("n_neighbors"))


ORACLE["tecplot_topology"] = "SELECT cell_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(cz AS DOUBLE) AS cz, CAST(zmin AS DOUBLE) AS zmin, CAST(zmax AS DOUBLE) AS zmax, n_nodes, n_neighbors FROM (VALUES (0, 0.25, 0.25, 0.25, 0.0, 1.0, 4, 1), (1, 0.25, 0.25, -0.25, -1.0, 0.0, 4, 1)) AS t(cell_id, cx, cy, cz, zmin, zmax, n_nodes, n_neighbors)"


@query()
def tecplot_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.sources.tecplot import read_part

    return read_part(spark, _tecplot_folder(spark), "scalars")


ORACLE["tecplot_frames"] = (
    "SELECT step, zone, var, CAST(cell_id AS BIGINT) AS cell_id, CAST(value AS DOUBLE) AS value FROM (VALUES "
    + ", ".join(
        f"({s}, '0_Fluid', '{v}', {k}, {x})"
        for s, u, p in ((200, (1, 2), (7, 8)), (400, (2, 4), (9, 10)))
        for v, xs in (("U", u), ("V", (3, 4)), ("W", (5, 6)), ("P", p), ("K", (9, 10)), ("E", (11, 12)))
        for k, x in enumerate(xs)
    )
    + ", "
    + ", ".join(f"({s}, '0_Wall_hull', '{v}', 0, {42 if v == 'P' else 0})" for s in (200, 400) for v in "UVWPKE")
    + ") AS t(step, zone, var, cell_id, value)"
)
