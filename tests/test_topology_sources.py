from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import topology
from spindrift.plans.workload_queries import TWO_ZONES
from spindrift.sources import odbh5, sinks, tecplot
from spindrift.sources.model import discover, preferred_zone, read_mesh, read_table, register_tables, surface_zone_order, write_mesh
from tests.meshes import CUBE, TETRA, mesh


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    root = tmp_path_factory.mktemp("tec")
    for name, u, p in (("200_case.dat", "1 2", "7 8"), ("1000_case.dat", "5 5", "1 1"), ("400_case.dat", "2 4", "9 10")):
        (root / name).write_text(TWO_ZONES.format(u=u, p=p))
    return str(root)


def test_frames_come_in_order_of_their_steps(case):
    assert [tecplot.step_of(f) for f in tecplot.frame_files(case)] == [200, 400, 1000]
    with pytest.raises(ValueError):
        tecplot.step_of("case.dat")


def test_two_tetrahedra(spark, case):
    m = tecplot.read_tecplot(spark, case, "0_Fluid")
    cells = {r["cell_id"]: (r["cx"], r["cy"], r["cz"]) for r in m.cells.collect()}
    assert cells == {0: (0.25, 0.25, 0.25), 1: (0.25, 0.25, -0.25)}
    assert sorted((r["cell_id"], r["neighbor_id"]) for r in m.edges.collect()) == [(0, 1), (1, 0)]
    assert {r["cell_id"]: r["node_ids"] for r in m.cell_nodes.collect()} == {0: [0, 1, 2, 3], 1: [0, 1, 2, 4]}
    faces = m.boundary_faces.collect()
    assert len(faces) == 6
    for f in faces:
        c = np.array(cells[f["cell_id"]])
        assert np.dot((f["nx"], f["ny"], f["nz"]), np.array((f["cx"], f["cy"], f["cz"])) - c) > 0
    assert sorted(r[0] for r in m.cell_scalar.select("step").distinct().collect()) == [200, 400, 1000]
    from spindrift.operators.fields import max_neighbor_diff

    got = {(r["step"], r["var"]): r["max_diff"] for r in max_neighbor_diff(m.edges, m.cell_scalar).collect()}
    assert got[200, "U"] == 1 and got[400, "U"] == 2


def test_hull_of_edges(spark, case):
    m = tecplot.read_tecplot(spark, case, "0_Wall_hull")
    assert m.cell_nodes.first()["node_ids"] == [0, 1, 2, 3]
    c = m.cells.first()
    assert (c["cx"], c["cy"], c["cz"]) == (0.5, 0.5, 0)
    assert m.boundary_faces.count() == 0
    assert m.cell_scalar.where("step = 200 AND var = 'P'").first()["value"] == 42
    assert tecplot.parse_first_zone(case) == "0_Fluid"


@pytest.mark.parametrize("change", [("1 2 3   1 4 2", "1 2   1 4 2"), ("2 0 0 0 0 0 0", "9 0 0 0 0 0 0"), ("0 1 0 0 0\n0 0 1 1 0".replace("1 1 0", "1 0 0"), ""), ("# left elements\n1 1 1 1 2 2 2", "")])
def test_broken_files_raise(change):
    text = TWO_ZONES.format(u="1 2", p="7 8")
    assert change[0] in text
    with pytest.raises(ValueError):
        tecplot.parse(text.replace(change[0], change[1], 1))


def test_changed_cell_counts_raise(spark, tmp_path):
    (tmp_path / "1_a.dat").write_text(TWO_ZONES.format(u="1 2", p="7 8"))
    (tmp_path / "2_a.dat").write_text(TWO_ZONES.format(u="1 2", p="7 8").replace("E =2", "E =1").replace("Elements =2", "Elements =1"))
    with pytest.raises(ValueError):
        tecplot.check_frames(spark, str(tmp_path))


def ten_node(*cells):
    return [(k, list(ids), "C3D10") for k, ids in enumerate(cells)]


def test_ten_node_tetrahedra_need_a_whole_face(spark):
    cells = ten_node(range(10), [0, 1, 2, 10, 4, 5, 6, 11, 12, 13], [0, 1, 20, 21, 4, 22, 23, 24, 25, 26])
    found = topology.adjacency_by_nodes(spark.createDataFrame(cells, "cell_id long, node_ids array<long>, element_type string")).collect()
    assert sorted(map(tuple, found)) == [(0, 1), (1, 0)]


def test_adjacency_thresholds_by_family(spark):
    rows = [(0, [0, 1], "B33"), (1, [1, 2], "B33"), (2, [10, 11, 12, 13], "S4"), (3, [12, 13, 14, 15], "S4"), (4, [13, 16, 17, 18], "S4"), (5, [13, 19], "B31"), (6, [30, 31, 32, 33], None), (7, [32, 33, 34, 35], "")]
    found = {tuple(r) for r in topology.adjacency_by_nodes(spark.createDataFrame(rows, "cell_id long, node_ids array<long>, element_type string")).collect() if r[0] < r[1]}
    assert found == {(0, 1), (2, 3), (2, 5), (3, 5), (4, 5), (6, 7)}


def test_nodal_means_need_all_nodes(spark):
    m = mesh(spark, [(k, 0, 0) for k in range(3)], [(0, 1), (1, 2)], node_scalars=[(0, "V", 0, 0), (0, "V", 1, -1), (1, "V", 0, 1), (1, "V", 1, 1), (1, "V", 2, 3)])
    got = {(r["step"], r["cell_id"]): r["value"] for r in topology.nodal_to_cell(m.cell_nodes, m.node_scalar).collect()}
    assert got == {(0, 0): -0.5, (1, 0): 1, (1, 1): 2}


def test_components_types_and_hulls(spark):
    r = spark.range(1).select(topology.component(F.array(F.lit(3.0), F.lit(4.0)), None).alias("n"), topology.component(F.array(F.lit(3.0), F.lit(4.0)), 1).alias("c")).first()
    assert (r["n"], r["c"]) == (5, 4)
    kinds = [("C3D4", 4, 10), ("C3D8", 8, 12), ("C3D10", 10, 24), ("S4", 4, 9), ("S3", 3, 5), ("B33", 2, 3), (None, 8, 12), (None, 7, 41)]
    got = spark.createDataFrame(kinds, "t string, n int, e int").select((topology.vtk_cell_type(F.col("t"), F.col("n")) == F.col("e")).alias("ok")).collect()
    assert all(r["ok"] for r in got)
    assert len(topology.hull_triangles(TETRA)) == 4 and len(topology.hull_triangles(CUBE)) == 12
    assert len(topology.hull_triangles([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)])) in (0, 2)


class Data:
    def __init__(self, rows):
        self.rows = np.array(rows)

    def __getitem__(self, key):
        return self.rows


def beam(modal=False):
    group = odbh5.Group

    def frame(scale, **at):
        u = group({"PART-1-1": group({"Real": Data([[0, 0, 0], [0, -scale, 0], [0, -2 * scale, 0]])})}, ComponentLabels=["U1", "U2", "U3"])
        return group({"U": u}, **at)

    if modal:
        frames = {"Frame:0": group({}, Inc__Mode=0), **{f"Frame:{k}": frame(float(k), Inc__Mode=k, Time__Freq=10.0 * k) for k in (1, 2)}}
    else:
        one = frame(1.0, Inc__Mode=1, Time__Freq=1.0)
        for name, rows, labels in (("E", [1, 3, 5, 7], ["E11", "E22", "E12"]), ("S", [10, 20, 30, 40], ["S11", "S22", "S12"])):
            one[name] = group({"PART-1-1": group({"ElementClass:0": group({"LocationIndex:1": group({"Real": Data([[v, 0, 0] for v in rows])})})})}, ComponentLabels=labels)
        frames = {"Frame:0": one}
    nodes = group({"Labels": Data([1, 2, 3]), "Coordinates": Data([[0, 0, 0], [1, 0, 0], [2, 0, 0]])})
    elements = group({"ElementClass:0": group({"Labels": Data([1, 2]), "Connectivities": Data([[0, 1], [1, 2]])}, ElementType=b"B33")})
    return group(
        {"Parts": group({"PART-1": group({"Nodes": nodes, "Elements": elements})}), "Assembly": group({"Instances": group({"PART-1-1": group({}, PartName="PART-1")})}), "Steps": group({"Step-1": group({"Frames": group(frames)}, Index=1, Domain=2 if modal else 0)})}
    )


def test_beam_static(spark):
    m, plan, types = odbh5.read_odb(spark, beam(), explicit={"STRESS": ("S", "S11")})
    cell = {(r["var"], r["cell_id"]): r["value"] for r in m.cell_scalar.collect()}
    assert [cell["V", k] for k in (0, 1)] == [-0.5, -1.5]
    assert [cell["E", k] for k in (0, 1)] == [2, 6] and [cell["STRESS", k] for k in (0, 1)] == [15, 35]
    node = {(r["var"], r["node_id"]): r["value"] for r in m.node_scalar.collect()}
    assert [node["V", k] for k in range(3)] == [0, -1, -2]
    assert sorted(map(tuple, m.edges.collect())) == [(0, 1), (1, 0)]
    assert types.first()["element_type"] == "B33" and plan.skipped == ()
    from spindrift.operators.fields import max_neighbor_diff

    diffs = {r["var"]: r["max_diff"] for r in max_neighbor_diff(m.edges, m.cell_scalar, "range").collect()}
    assert diffs["V"] == 1 and diffs["E"] == 4


def test_beam_modal_frames_and_steps(spark):
    reader = odbh5.OdbReader(beam(modal=True))
    plan = reader.plan()
    assert [s for s, _, _ in plan.frames] == [0, 1] and plan.skipped == ("Step-1/Frame:0",)
    assert [s for s, _, _ in reader.plan(timestep="inc-mode").frames] == [1, 2]
    assert odbh5.frame_metadata(spark, plan).orderBy("step").collect()[1]["time_or_frequency"] == 20
    with pytest.raises(ValueError):
        reader.plan(timestep="other")
    with pytest.raises(ValueError):
        reader.plan(instance="nope")
    assert reader.inspect()["instances"] == {"PART-1-1": "PART-1"}


def test_store_round_trip_and_discovery(spark, case, tmp_path):
    root = str(tmp_path / "store")
    for zone in ("0_Fluid", "0_Wall_hull"):
        write_mesh(tecplot.read_tecplot(spark, case, zone), root, "two_tets", zone)
    write_mesh(tecplot.read_tecplot(spark, case, "0_Fluid"), root, "two_tets", "0_Fluid")
    m = read_mesh(spark, root, "two_tets", "0_Fluid")
    assert m.cells.count() == 2 and m.cell_scalar.count() == 36 and m.edges.count() == 2
    found = {r["zone"]: r for r in discover(read_table(spark, root, "cell_scalar")).collect()}
    assert found["0_Fluid"]["steps"] == [200, 400, 1000] and found["0_Wall_hull"]["variables"] == sorted("UVWPKE")
    register_tables(spark, root, "mesh_test")
    assert spark.sql("SELECT count(*) FROM mesh_test.cell_scalar WHERE zone = '0_Fluid' AND step = 400").first()[0] == 12
    spark.sql("DROP DATABASE mesh_test CASCADE")
    assert preferred_zone(list(found)) == "0_Fluid" and surface_zone_order(list(found)) == ["0_Wall_hull", "0_Fluid"]


def test_vtk_grid_round_trip(spark, case):
    m = tecplot.read_tecplot(spark, case, "0_Fluid")
    back = sinks.read_vtu(spark, sinks.vtu_text(m, 400, ["U", "P"]))
    assert {r["cell_id"]: r["node_ids"] for r in back.cell_nodes.collect()} == {0: [0, 1, 2, 3], 1: [0, 1, 2, 4]}
    assert {(r["var"], r["cell_id"]): r["value"] for r in back.cell_scalar.collect()} == {("U", 0): 2, ("U", 1): 4, ("P", 0): 9, ("P", 1): 10}


def test_max_diff_files_results_and_ratio(spark, tmp_path):
    diffs = spark.createDataFrame([(1, "U", 0.5), (2, "U", 0.25)], "step int, var string, max_diff double")
    sinks.write_max_diffs(diffs, str(tmp_path / "d"))
    assert sorted((r["step"], r["max_diff"]) for r in sinks.read_max_diffs(spark, str(tmp_path / "d")).collect()) == [(1, 0.5), (2, 0.25)]
    log = sinks.ResultLog(str(tmp_path / "r" / "out.csv"))
    row = log.add("d", "w2", "box", 3, 1.5, 200)
    assert row["txns_per_sec"] == "2" and len((tmp_path / "r" / "out.csv").read_text().splitlines()) == 2
    rows = [("w2", "box", "1", b, t) for b, t in (("a", "2"), ("a", "4"), ("b", "5"), ("base", "2"))] + [("w9", "x", "", "a", "9"), ("w4", "y", "", "a", "9")]
    r = sinks.rate_ratio(spark.createDataFrame(rows, "workload string, operation string, step string, backend string, txns_per_sec string"), ["a", "b"], "base").first()
    assert (r["our_tpm"], r["baseline_tpm"], r["ratio"]) == (240, 120, 2)
    assert json.dumps(row)


def test_coupling_export(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 0, 4, 1.5), (1, float("nan"), 0.0, 0.0, 3, None, None)], "point_id long, x double, y double, z double, status int, cell_id long, P double")
    sinks.write_coupling(df, str(tmp_path / "c"), {"step": "1"})
    sinks.coupling_csv(spark.read.parquet(str(tmp_path / "c" / "points")), str(tmp_path / "csv"), ["P"])
    rows = {r["point_id"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert rows["0"]["status"] == "PASS" and float(rows["0"]["x"]) == 0.1 and rows["1"]["x"] is None


def test_a_zone_written_again_keeps_no_former_rows(spark, tmp_path):
    from spindrift.sources.model import FRAMES, read_mesh, write_mesh
    from tests.meshes import TETRA, mesh

    root = str(tmp_path / "store")
    full = mesh(spark, TETRA, [range(4)], scalars=[(1, "P", 0, 2.0), (2, "P", 0, 3.0)], node_scalars=[(1, "T", 0, 5.0), (2, "T", 0, 6.0)])
    for zone in ("a:b", "other"):
        write_mesh(full, root, "d", zone)
    bare = mesh(spark, TETRA, [range(4)], scalars=[(1, "P", 0, 9.0)])
    bare = type(bare)(**{**bare.tables(), "node_source": bare.node_source.where("false")})
    write_mesh(bare, root, "d", "a:b")
    got, kept = read_mesh(spark, root, "d", "a:b"), read_mesh(spark, root, "d", "other")
    assert got.node_source.count() == 0 and kept.node_source.count() == 4
    assert sorted(map(tuple, got.cell_scalar.select("step", "value").collect())) == [(1, 9.0), (2, 3.0)]
    # frame 1 is written anew without nodal values, frame 2 is not written and stays
    assert [tuple(r) for r in got.node_scalar.select("step", "value").collect()] == [(2, 6.0)]
    assert all(getattr(kept, name).count() == 2 for name in FRAMES)
