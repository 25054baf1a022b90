from __future__ import annotations

import math

import numpy as np
import pytest

from spindrift.functions.simplex import deepest, supports
from spindrift.operators import interpolate, trace
from spindrift.operators import align
from tests.meshes import CUBE, TETRA, mesh


def affine(p):
    return 4 + p[0] + 2 * p[1] + 3 * p[2]


def test_affine_field_in_a_tetrahedron():
    s = supports([(0.2, 0.3, 0.1)], TETRA)[0]
    assert sum(w * affine(TETRA[i]) for i, w in zip(s.local, s.weights)) == pytest.approx(affine((0.2, 0.3, 0.1)))


def test_support_does_not_depend_on_vertex_order():
    p = np.array((0.31, 0.47, 0.62))
    rng = np.random.default_rng(5)
    for _ in range(5):
        order = rng.permutation(8)
        v = np.array(CUBE, float)[order]
        s = supports([p], v)[0]
        assert np.linalg.norm(s.weights @ v[list(s.local)] - p) < 1e-10 and s.margin > 0
    shifted = np.array(CUBE, float) + 1e6
    assert supports([p + 1e6], shifted)[0] is not None


def test_supports_of_many_cells_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(7)
    boxes = np.array(CUBE, float) + rng.integers(0, 9, (200, 1, 3))
    boxes[50:60] = rng.normal(size=(10, 8, 3))
    boxes[60], boxes[61, 3], boxes[62, :, 2] = 0, np.nan, 1  # one place, not finite, flat
    cell = rng.integers(0, 200, 600)
    points = boxes[cell].mean(axis=1) + rng.normal(size=(600, 3)) * 0.3
    points[::7] = boxes[cell[::7], 0]  # corners: ties of margin
    want = {k: s for k in range(600) if (s := supports([points[k]], boxes[cell[k]])[0]) is not None}
    calls = []
    svd = np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda a, **b: calls.append(a.shape) or svd(a, **b))
    rows, local, w, error, condition, margin = deepest(points, cell, boxes)
    assert sorted(rows.tolist()) == sorted(want) and 200 < len(want) < 600
    for i, k in enumerate(rows.tolist()):
        s = want[k]
        assert tuple(local[i]) == s.local and (w[i] == s.weights).all() and (error[i], condition[i], margin[i]) == (s.error, s.condition, s.margin)
    # one factoring for all cells, and one for all copies of a box
    assert len(calls) == 1 and calls[0][0] < 20


def test_outside_degenerate_and_bad_points():
    found = supports([(2, 2, 2), (float("nan"), 0, 0), (0.1, 0.1, 0.1)], TETRA)
    assert found[0] is None and found[1] is None and found[2] is not None
    assert supports([(0, 0, 0)], [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]) == [None]
    assert supports([(0, 0, 0)], TETRA[:3]) == [None]


@pytest.fixture(scope="module")
def tetra(spark):
    return mesh(spark, TETRA, [(0, 1, 2, 3)], scalars=[(7, "P", 0, 7.5), (7, "U", 0, -2.0), (7, "N", 0, float("nan"))])


def test_interpolate_values_and_errors(tetra):
    got = interpolate.interpolate(tetra, (0.2, 0.2, 0.2), ["P", "U"], 7)
    assert got["values"] == {"P": pytest.approx(7.5), "U": pytest.approx(-2)} and got["cell_id"] == 0
    with pytest.raises(ValueError, match="outside the mesh AABB"):
        interpolate.interpolate(tetra, (2, 2, 2), ["P"], 7)
    with pytest.raises(ValueError, match="no cell"):
        interpolate.interpolate(tetra, (0.8, 0.8, 0.8), ["P"], 7)
    with pytest.raises(ValueError, match="finite"):
        interpolate.interpolate(tetra, (0.2, 0.2, 0.2), ["N"], 7)


def test_coupling_statuses(spark, tetra):
    pts = [(0, 0.2, 0.2, 0.2), (1, 2.0, 2.0, 2.0), (2, 0.8, 0.8, 0.8), (3, 0.1, 0.1, 0.1), (4, float("nan"), 0.0, 0.0)]
    out = interpolate.couple(spark.createDataFrame(pts, "point_id long, x double, y double, z double"), tetra, ["P", "U"], 7)
    rows = {r["point_id"]: r for r in out.collect()}
    assert [rows[k]["status"] for k in range(5)] == [0, 1, 2, 0, 3]
    assert rows[0]["P"] == pytest.approx(7.5) and rows[3]["U"] == pytest.approx(-2) and rows[1]["P"] is None and rows[2]["P"] is None
    assert {r["status"]: r["n"] for r in interpolate.status_counts(out).collect()} == {"PASS": 2, "OUTSIDE_MESH": 1, "NO_CONTAINING_CELL": 1, "INTERPOLATION_FAILED": 1}


def test_streamline_endings(spark):
    ids = [range(8)]
    pts = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 2.0, 2.0, 2.0)], "point_id long, x double, y double, z double")
    flow = lambda u: mesh(spark, CUBE, ids, scalars=[(0, v, 0, x) for v, x in zip("UVW", u)])
    gone = trace.streamlines(pts, flow((1, 0, 0)), 0).collect()
    assert [(r["point_id"], r["moves"], r["reason"]) for r in gone] == [(0, 0, "left")]
    slow = trace.streamlines(pts, flow((0.01, 0, 0)), 0, max_steps=3).collect()
    assert [(r["moves"], r["reason"]) for r in slow] == [(3, "cap")] and slow[0]["x"] == pytest.approx(0.53)
    still = trace.streamlines(pts, flow((0, 0, 0)), 0).collect()
    assert [(r["moves"], r["reason"]) for r in still] == [(0, "still")]


def test_advection_over_frames(spark):
    scalars = [(s, v, 0, x) for s in (1, 2, 3) for v, x in zip("UVW", (10.0 * s, 0.0, 0.0))]
    m = mesh(spark, CUBE, [range(8)], scalars=scalars)
    pts = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 0.1, 0.5, 0.5)], "point_id long, x double, y double, z double")
    rows = {r["point_id"]: r for r in trace.advect(pts, m, [1, 2, 3], dt=0.01).collect()}
    assert rows[0]["moves"] == 2 and rows[0]["x"] == pytest.approx(0.8)
    assert rows[1]["moves"] == 3 and rows[1]["x"] == pytest.approx(0.7)


def cloud(spark, points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")


def test_alignment_recovers_a_similarity(spark):
    rng = np.random.default_rng(7)
    source = rng.uniform(-1, 1, (3000, 3)) * (5000, 1200, 700)
    a = math.radians(13)
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    target = 0.001 * source @ turn.T + (1.3, -0.25, 0.6)
    odd = [(float("nan"), 0.0, 0.0), (9e9, 9e9, 9e9), tuple(source[0])]
    fit = align.align_tables(cloud(spark, [*source, *odd]), cloud(spark, target))
    assert fit.transform.scale == pytest.approx(0.001, rel=1e-7) and fit.confidence == "high"
    assert np.abs(fit.transform.rotation - turn).max() < 1e-7 and np.abs(fit.transform.translation - (1.3, -0.25, 0.6)).max() < 1e-7


def test_nearest_points_and_paired_fit_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    points, targets = rng.normal(size=(80, 3)) * (9, 3, 1), rng.normal(size=(60, 3))
    rows = [(k, *map(float, p)) for k, p in enumerate(points)]
    for step in (0.05, 2.0, 100.0):
        got = align.nearest_points(spark.createDataFrame(rows, "id long, x double, y double, z double"), cloud(spark, targets), step, targets.min(axis=0)).collect()
        best = {k: min(((p - t) ** 2).sum() for t in targets) for k, p in enumerate(points)}
        assert len(got) == len(points) and all(r["d2"] == pytest.approx(best[r["id"]]) for r in got)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.linalg.det(turn)
    pairs = [(*map(float, p), *map(float, 2.5 * turn @ p + (1, 2, 3))) for p in points]
    fit = align.fit_pairs(spark.createDataFrame(pairs, "x double, y double, z double, tx double, ty double, tz double"))
    assert fit.scale == pytest.approx(2.5) and np.allclose(fit.rotation, turn) and np.allclose(fit.translation, (1, 2, 3))


def test_surface_of_a_solid_cloud(spark):
    grid = np.stack(np.meshgrid(*[np.arange(7)] * 3), axis=-1).reshape(-1, 3)
    got = {tuple(r) for r in align.surface_of(cloud(spark, grid), bins=7).collect()}
    assert got == {tuple(map(float, p)) for p in grid if 0 in p or 6 in p}


def test_alignment_as_columns_and_zone_choice(spark):
    move = align.Similarity(2.0, np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]), np.array([1.0, 0, 0]))
    r = move.transform(spark.createDataFrame([(9, 1.0, 2.0, 3.0)], "point_id long, x double, y double, z double")).first()
    assert (r["point_id"], r["x"], r["y"], r["z"]) == (9, -3, 2, 6)
    assert align.alignment_zone(["0_Fluid", "1_Wall_hull"]) == "1_Wall_hull"
    with pytest.raises(ValueError):
        align.alignment_zone(["0_Fluid"])
    with pytest.raises(ValueError):
        align.align_tables(cloud(spark, np.eye(3)), cloud(spark, np.zeros((9, 3))))


def test_registered_streamlines_run_to_their_ends(spark, sf_dir):
    from spindrift.plans.queries import STEP, lattice_mesh, probe_points, streamline_w5

    m = lattice_mesh(spark, sf_dir)
    boxes = [(r["cell_id"], (r["xmin"], r["xmax"]), (r["ymin"], r["ymax"]), (r["zmin"], r["zmax"]), (r["cx"], r["cy"], r["cz"])) for r in m.cells.collect()]
    flow = {}
    for r in m.cell_scalar.where(f"step = {STEP} AND var IN ('U', 'V', 'W')").collect():
        flow.setdefault(r["cell_id"], {})[r["var"]] = r["value"]

    def cell(p):
        held = [(sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, *box, c in boxes if all(lo <= a <= hi for a, (lo, hi) in zip(p, box))]
        return min(held)[1] if held else None

    slow = {}
    for r in probe_points(spark, sf_dir).where("point_id % 7 = 0").collect():
        p, moves = (r["x"], r["y"], r["z"]), 0
        at = cell(p)
        while at is not None:
            v = [flow.get(at, {}).get(k) for k in "UVW"]
            if any(x is None for x in v) or sum(x * x for x in v) ** 0.5 <= 1e-15:
                slow[r["point_id"]] = (moves, at, "still")
                break
            p = tuple(a + x * 0.05 for a, x in zip(p, v))
            nxt = cell(p)
            if nxt is None:
                slow[r["point_id"]] = (moves, at, "left")
                break
            at, moves = nxt, moves + 1
    rows = streamline_w5(spark, sf_dir).collect()
    assert {r["reason"] for r in rows} <= {"still", "left"}
    got = {r["point_id"]: (r["moves"], r["cell_id"], r["reason"]) for r in rows if r["point_id"] % 7 == 0}
    assert got == slow and max(n for n, *_ in slow.values()) > 6
