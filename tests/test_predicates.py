from __future__ import annotations

import random

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions.geometry import outside_axes, plane_hit, segment_entry
from spindrift.operators import fields, locate
from spindrift.sources.model import SCHEMAS
from tests.meshes import box_cells, boxes


def entry(p0, p1, box, eps=1e-9):
    t0, t1 = 0.0, 1.0
    for i in range(3):
        lo, hi, d = box[2 * i], box[2 * i + 1], p1[i] - p0[i]
        if abs(d) < eps:
            if not lo - eps <= p0[i] <= hi + eps:
                return None
            continue
        a, b = sorted(((lo - p0[i]) * (1 / d), (hi - p0[i]) * (1 / d)))
        t0, t1 = max(t0, a), min(t1, b)
    return t0 if t0 <= t1 + eps else None


def hits_plane(o, n, box, eps=1e-9):
    size = math.sqrt(sum(v * v for v in n))
    if size < eps:
        return False
    c = [(box[2 * i] + box[2 * i + 1]) / 2 for i in range(3)]
    r = [(box[2 * i + 1] - box[2 * i]) / 2 for i in range(3)]
    return abs(sum((a - b) * v / size for a, b, v in zip(c, o, n))) <= sum(a * abs(v) / size for a, v in zip(r, n)) + eps


def test_box_selection_and_bounds_in_either_order(spark):
    cells = box_cells(spark)
    lo, hi = (3, 2, -1), (8.8, 6.8, 2)
    expected = [b[0] for b in boxes() if all(b[4 + 2 * i] >= lo[i] and b[5 + 2 * i] <= hi[i] for i in range(3))]
    assert sorted(r[0] for r in fields.range_coord(cells, lo, hi).collect()) == expected
    assert fields.range_coord(cells, hi, lo).count() == len(expected)
    centred = [b[0] for b in boxes() if all(lo[i] <= b[1 + i] <= hi[i] for i in range(3))]
    assert sorted(r[0] for r in fields.range_coord(cells, lo, hi, "centroid").collect()) == centred
    with pytest.raises(ValueError):
        fields.range_coord(cells, lo, hi, "other")


def test_segment_hits_are_ordered_along_it(spark):
    p0, p1 = (-1, 2.4, 0.4), (21, 2.4, 0.4)
    rows = box_cells(spark).select("cell_id", segment_entry(p0, p1).alias("t")).where("t IS NOT NULL").orderBy("t", "cell_id").collect()
    expected = sorted((t, b[0]) for b in boxes() if (t := entry(p0, p1, b[4:])) is not None)
    assert [r["cell_id"] for r in rows] == [k for _, k in expected]
    assert [r["cell_id"] for r in rows] == list(range(40, 60))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.tuples(*[st.floats(-2, 22)] * 6), st.tuples(*[st.floats(-1, 1)] * 3))
def test_predicates_agree_with_scalar_code(spark, line, normal):
    p0, p1 = line[:3], line[3:]
    cells = box_cells(spark)
    got = {r["cell_id"]: (r["t"], r["h"]) for r in cells.select("cell_id", segment_entry(p0, p1).alias("t"), plane_hit(p0, normal).alias("h")).collect()}
    for b in boxes():
        t = entry(p0, p1, b[4:])
        assert (got[b[0]][0] is None) == (t is None)
        assert t is None or got[b[0]][0] == pytest.approx(t, abs=1e-12)
        assert got[b[0]][1] == hits_plane(p0, normal, b[4:])


def test_plane_with_zero_normal(spark):
    assert box_cells(spark).where(plane_hit((0, 0, 0), (0, 0, 0))).count() == 0
    with pytest.raises(ValueError):
        plane_hit((0, 0, 0), (0, 0, 0), zero_normal="raise")


@pytest.mark.parametrize("name", ["locate_nearest", "locate_first", "locate_nearest_in_bucket"])
def test_location_of_known_points(spark, name):
    points = spark.createDataFrame([(0, 0.4, 0.4, 0.4), (1, 1e6, 1e6, 1e6), (2, 7.1, 3.2, 0.3)], "point_id long, x double, y double, z double")
    cells = box_cells(spark)
    grid = locate.grid_of(cells, (20, 10, 1))
    rows = {r["point_id"]: r["cell_id"] for r in getattr(locate, name)(points, cells, grid).collect()}
    assert rows[0] == 0 and rows[2] == 67
    assert rows[1] is None or name == "locate_nearest_in_bucket"
    assert getattr(locate, name)(points, cells, grid, misses=False).count() in (2, 3)


def test_location_matches_a_scan_for_overlapping_boxes(spark):
    rows = [(k, 0.0, 0.0, 0.0, -1.0 - k, 1.0 + k / 2, -1.0 - k % 3, 2.0, -50.0 * (k % 2), 1.0 + k) for k in range(40)]
    cells = spark.createDataFrame([(r[0], (r[4] + r[5]) / 2, (r[6] + r[7]) / 2, (r[8] + r[9]) / 2, *r[4:]) for r in rows], box_cells(spark).schema)
    pts = [(k, -5 + 0.37 * k, -3 + 0.11 * k, -40 + 1.7 * k) for k in range(40)]
    points = spark.createDataFrame(pts, "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["cell_id"] for r in locate.locate_nearest(points, cells).collect()}
    for p in pts:
        held = [r for r in rows if all(r[4 + 2 * i] <= p[1 + i] <= r[5 + 2 * i] for i in range(3))]
        best = min(held, key=lambda r: (sum((p[1 + i] - (r[4 + 2 * i] + r[5 + 2 * i]) / 2) ** 2 for i in range(3)), r[0]), default=None)
        assert got[p[0]] == (best[0] if best else None)


def test_location_plan_has_no_nested_loop(spark):
    points = spark.createDataFrame([(0, 0.4, 0.4, 0.4)], "point_id long, x double, y double, z double")
    plan = locate.locate_nearest(points, box_cells(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_outside_axes(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.5), (-1.0, 2.0, 0.5), (1.0 + 1e-13, 0.0, 0.0)], "x double, y double, z double")
    sides, gap = outside_axes([F.col(a) for a in "xyz"], (0, 0, 0), (1, 1, 1))
    got = rows.select(sides.alias("s"), gap.alias("d")).collect()
    assert got[0]["s"] == [] and got[0]["d"] == 0
    assert got[1]["s"] == ["x-", "y+"] and got[1]["d"] == pytest.approx(math.sqrt(2))
    assert got[2]["s"] == []


def test_buckets_stay_small_on_a_graded_mesh(spark):
    """Thin layers beside wide cells: every axis has its own levels, so no bucket holds many cells."""
    cells, top = [], 0.0
    for k in range(40):
        thick = 0.001 * 1.25**k
        cells += [(len(cells), i + 0.5, j + 0.5, top + thick / 2, float(i), i + 1.0, float(j), j + 1.0, top, top + thick) for i in range(12) for j in range(12)]
        top += thick
    cells += [(len(cells) + k, 20.0 + k, 6.0, top / 2, 14.0 + 6 * k, 20.0 + 6 * k, 0.0, 12.0, 0.0, top) for k in range(3)]
    table = spark.createDataFrame(cells, SCHEMAS["cells"])
    grid = locate.grid_of(table)
    assert 1 < len(grid.levels) <= locate.PROBES
    dealt = locate.bucketed(table, grid)
    most = dealt.groupBy("lx", "ly", "lz", "ix", "iy", "iz").count().agg({"count": "max"}).first()[0]
    assert most <= 27 and dealt.count() <= 8 * len(cells)
    rng = random.Random(2)
    points = [(k, rng.uniform(-1, 33), rng.uniform(-1, 13), rng.uniform(0, 1) ** 4 * top * 1.1) for k in range(300)]
    got = {r["point_id"]: r["cell_id"] for r in locate.locate_nearest(spark.createDataFrame(points, "point_id long, x double, y double, z double"), table, grid).collect()}
    for k, *p in points:
        held = [(sum((v - (c[4 + 2 * a] + c[5 + 2 * a]) / 2) ** 2 for a, v in enumerate(p)), c[0]) for c in cells if all(c[4 + 2 * a] <= v <= c[5 + 2 * a] for a, v in enumerate(p))]
        assert got[k] == (min(held)[1] if held else None)
