"""Exact containment, exact segment hits and stored results against slow code."""

from __future__ import annotations

import numpy as np
import pytest

from spindrift import cli
from spindrift.operators import shells, topology
from spindrift.plans.session import MeshSession
from spindrift.sources import derived
from spindrift.sources.lattice import lattice_mesh
from spindrift.sources.model import write_mesh
from tests.meshes import CUBE, TETRA, mesh


def test_hull_faces_of_many_cells_are_those_of_each():
    rng = np.random.default_rng(5)
    clouds = rng.normal(size=(7, 9, 3))
    clouds[3] = clouds[3].round()  # coplanar and repeated points
    cell, normal, offset, on = topology.hull_faces(clouds)
    for k, p in enumerate(clouds):
        _, n1, d1, on1 = topology.hull_faces(p[None])
        mine = cell == k
        assert np.allclose(normal[mine], n1) and np.allclose(offset[mine], d1) and (on[mine] == on1).all()
        assert ((p @ normal[mine].T - offset[mine]).max() <= 1e-9) and on[mine].sum(axis=1).min() >= 3
    cube = topology.hull_faces(np.array([CUBE], float))
    assert len(cube[0]) == 6 and (cube[3].sum(axis=1) == 4).all()
    assert len(topology.hull_faces(np.zeros((2, 3, 3)))[0]) == 0


def test_triangles_of_many_cells_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    clouds = rng.integers(0, 3, size=(40, 8, 3)).astype(float)  # squares, flat cells, repeated points
    clouds[:3] = np.array(CUBE, float) * 1.7
    cell, corners = topology._fans(clouds)
    for k, p in enumerate(clouds):
        assert (corners[cell == k] == topology.hull_triangles(p)).all()
    assert (np.bincount(cell)[:3] == 12).all()
    nodes, cells, m = random_mesh(spark)
    out = topology.cell_shells(m)
    # whole Arrow batches: no Python loop over cells or triangles
    assert "MapInArrow" in out._jdf.queryExecution().sparkPlan().toString()
    got = {}
    for r in out.orderBy("cell_id", "tri").collect():
        got.setdefault(r["cell_id"], []).append([[r[f"{n}{c}"] for c in "xyz"] for n in "abc"])
        assert r["tri"] == len(got[r["cell_id"]]) - 1
    for k, ids in enumerate(cells):
        want = topology.hull_triangles(nodes[list(ids)]) if len(ids) >= 4 else []
        assert len(got.get(k, [])) == len(want) and (not len(want) or np.allclose(got[k], nodes[list(ids)][want]))


def random_mesh(spark, n=12):
    rng = np.random.default_rng(8)
    nodes, cells = [], []
    for k in range(n):
        size = (4, 5, 6, 8)[k % 4]
        nodes += list(map(tuple, rng.normal(size=(size, 3)) * 0.7 + rng.uniform(0, 2, 3)))
        cells.append(list(range(len(nodes) - size, len(nodes))))
    nodes += [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0)]
    cells += [list(range(len(nodes) - 4, len(nodes))), [0, 1, 2], [0, 1]]  # flat, triangle, line: no inside
    return np.array(nodes), cells, mesh(spark, nodes, cells)


def test_exact_containment_of_random_polyhedra(spark):
    nodes, cells, m = random_mesh(spark)
    points = np.random.default_rng(9).uniform(-0.5, 2.5, (300, 3))
    points = np.vstack([points, nodes[:6], [[1, 1, 0], [50, 0, 0]]])

    def inside(p, ids):
        _, n, d, on = topology.hull_faces(nodes[ids][None])
        return len(n) > 0 and not on.all(axis=1).any() and (n @ p - d).max() <= 1e-9

    want = [min((k for k, ids in enumerate(cells) if inside(p, ids)), default=None) for p in points]
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["cell_id"] for r in shells.locate_exact(table, m).collect()}
    assert [got[k] for k in range(len(points))] == want
    assert sum(v is not None for v in want) > 30 and None in want
    hits = shells.locate_exact(table, m, misses=False)
    assert {r["point_id"] for r in hits.collect()} == {k for k, v in enumerate(want) if v is not None}
    assert shells.locate_exact(table.limit(0), m).count() == 0


def test_exact_segment_hits_of_random_polyhedra(spark):
    nodes, cells, m = random_mesh(spark)
    start, end = np.array([-1.0, -0.5, 0.2]), np.array([3.0, 2.6, 1.9])
    got = {r["cell_id"]: r["t"] for r in shells.segment_cells(m, start, end).collect()}
    steps = np.linspace(0, 1, 20001)
    along = start + steps[:, None] * (end - start)
    want = {}
    for k, ids in enumerate(cells):
        _, n, d, on = topology.hull_faces(nodes[ids][None])
        if len(n) and not on.all(axis=1).any():
            held = (along @ n.T - d <= 1e-9).all(axis=1)
            if held.any():
                want[k] = steps[held.argmax()]
    assert set(got) == set(want) and want
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_segments_along_faces_and_box_corners(spark):
    m = mesh(spark, [*CUBE, *((x + 5, y, z) for x, y, z in TETRA)], [range(8), range(8, 12)])
    hit = lambda a, b: [r["cell_id"] for r in shells.segment_cells(m, a, b).collect()]
    assert hit((-1, 0.5, 0), (2, 0.5, 0)) == [0]  # in the plane of a face
    assert hit((-1, 0.5, -0.1), (2, 0.5, -0.1)) == []
    # through the tetrahedron's box but past its slanted face
    corner = (5.9, 0.9, 0.9)
    assert hit(corner, corner) == [] and MeshSession(m).line_intersection(corner, corner).count() == 1
    session = MeshSession(m)
    at = session.points([corner, (5.1, 0.1, 0.1), (0.5, 0.5, 0.5)])
    assert [tuple(r) for r in session.point_intersection(at, "exact").select("point_id", "cell_id").collect()] == [(1, 1), (2, 0)]
    assert session.point_intersection(at).count() == 3
    assert session.line_intersection((5.1, 0.1, -1), (5.1, 0.1, 2), "exact").first()["t"] == pytest.approx(1 / 3)


def test_stored_results_are_read_and_replaced(spark, sf_dir, tmp_path):
    m, root = lattice_mesh(spark, sf_dir), str(tmp_path)
    for zone in ("0_Fluid", "1 Wall hull"):
        write_mesh(m, root, "d", zone)
    fresh = cli.stored_session(spark, root, "d", "0_Fluid", 3)
    assert fresh.list_zones() == ["0_Fluid", "1_Wall_hull"] and fresh.resolve_hull_zone() == "1_Wall_hull"
    assert fresh.variables_for_zone() == fresh.variables_for_zone("1 Wall hull") == ("E", "K", "P", "U", "V", "W")
    assert fresh.variables_for_zone("none") == ()
    computed = fresh.get_max_diffs()
    derived.store_max_diffs(fresh.mesh, root, "d", "0_Fluid")
    assert fresh.get_max_diffs() == computed
    planted = spark.createDataFrame([(3, "P", 7.5)], "step int, var string, max_diff double")
    derived.write_derived(planted, root, "max_diffs", "d", "0_Fluid")
    assert fresh.get_max_diffs() == {"P": 7.5} and set(fresh.get_max_diffs(2)) == set(computed)
    box = ((0, 0, 0), (20, 10, 1))
    q = fresh.query_vortex_cells(-40.0, *box).collect()
    derived.store_qcriterion(fresh.mesh, root, "d", "0_Fluid", 3)
    assert fresh._derived("qcriterion", 3) is not None and fresh.query_vortex_cells(-40.0, *box).collect() == q and q
    assert fresh._derived("qcriterion", 4) is None


def test_prepared_tables_change_no_answer(spark, sf_dir):
    s = MeshSession(lattice_mesh(spark, sf_dir), 3, "lattice")
    force, extrema = s.surface_force_query("P"), s.cfd_point_frame_extrema([1, 5, 40], "P")
    assert s.prepare_surface_force_query() and s.prepare_surface_force_query()
    s.prepare_cfd_point_queries()
    again = s.cfd_point_frame_extrema([1, 5, 40], "P")
    assert s.surface_force_query("P") == pytest.approx(force) and set(again) == set(extrema)
    assert all(again[k] == pytest.approx(extrema[k]) for k in again)
    assert s.list_zones() == ["0_Fluid"] and s.resolve_hull_zone() == "0_Fluid"


def test_geometry_keeps_cells_without_centroid(spark):
    m = mesh(spark, TETRA, [(0, 1, 2, 3), (0, 77)])
    lost = MeshSession(m).mesh.cells.where("cell_id = 0")
    from dataclasses import replace

    rows = {r["cell_id"]: r["cx"] for r in topology.cell_geometry(replace(m, cells=lost)).collect()}
    assert rows == {0: 0.25, 1: None}
