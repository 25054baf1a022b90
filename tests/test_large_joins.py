"""Joins of mesh-sized tables plan without a broadcast; nearest centroids without pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.storage import materialize
from spindrift.operators import locate
from spindrift.plans import shape_queries
from spindrift.plans.registry import QUERIES
from tests.meshes import box_cells

#: Findings of tables gathered on the driver, by query.
GATHERED = [
    "fallback_normals",
    "locate_first",
    "nodal_to_cell",
    "w11_extrema",
    "cells_from_nodes",
    "locate_nearest",
    "node_projection",
    "surface_normals",
    "w1_points",
    "point_extrema_projected",
    "isosurface_projected",
    "cell_shell_area",
    "couple_affine",
    "line_hits_exact_tetra",
    "w3_seeded_surface",
    "cell_shells_tetra",
    "couple",
    "couple_affine_tetra",
    "locate_exact_tetra",
]


@pytest.mark.parametrize("name", GATHERED)
def test_no_large_table_is_broadcast(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    # the lattice joins one row, the last cell id, by a nested loop; no other join may broadcast
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_coupling_broadcasts_nothing_on_the_way(spark, sf_dir, monkeypatch):
    """The plan of the result starts at tables written before it; theirs are held here."""
    written = {}
    monkeypatch.setattr("spindrift.operators.interpolate.materialize", lambda df, label, f=materialize: written.update({label: df}) or f(df, label))
    result = QUERIES["couple_affine"](spark, sf_dir)
    assert list(written) == ["couple-pairs", "couple-supports"]
    for df in (*written.values(), result):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_boxes_that_are_read_often_are_joined_once(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(locate, "grid_of", lambda cells, *a, f=locate.grid_of: seen.append(cells) or f(cells, *a))
    monkeypatch.setattr("spindrift.operators.shells.grid_of", locate.grid_of)
    monkeypatch.setattr("spindrift.operators.interpolate.grid_of", locate.grid_of)
    shape_queries.locate_exact_tetra(spark, sf_dir)
    shape_queries.couple_affine_tetra(spark, sf_dir)
    assert len(seen) == 2 and all("Join" not in c._jdf.queryExecution().optimizedPlan().toString() for c in seen)


def test_nearest_centroids_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, span in ((1, 1), (40, 3), (300, 6)):
        centres, points = rng.integers(0, span, (n, 3)).astype(float), rng.integers(-2, 2 * span, (200, 3)) / 2
        ids = rng.permutation(1000)[:n]
        got, d = locate.nearest_centroids(ids, centres, points)
        every = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (d == every.min(axis=1)).all()
        assert got.tolist() == [min(ids[every[i] == every[i].min()]) for i in range(len(points))]


def test_nearest_in_bucket_writes_no_pairs(spark, monkeypatch):
    cells = box_cells(spark)
    points = spark.range(600).select(F.col("id").alias("point_id"), (F.col("id") * 7 % 230 / 10.0 - 1).alias("x"), (F.col("id") * 3 % 110 / 10.0).alias("y"), F.when(F.col("id") > 0, F.lit(0.3)).alias("z"))
    grid = locate.grid_of(cells, (2, 2, 1))
    whole = {r["point_id"]: r["cell_id"] for r in locate.locate_nearest_in_bucket(points, cells, grid).collect()}
    monkeypatch.setattr(locate, "PART", 10)
    cut = locate.locate_nearest_in_bucket(points, cells, grid)
    assert {r["point_id"]: r["cell_id"] for r in cut.collect()} == whole and len(whole) == 600 and whole[0] is None
    centres = {r["cell_id"]: r for r in cells.select("cell_id", "cx", "cy", "cz", *(grid.bucket(F.col(f"c{a}"), i).alias(f"i{a}") for i, a in enumerate("xyz"))).collect()}
    for p in points.where("point_id > 0").select("point_id", *"xyz", *(grid.bucket(F.col(a), i).alias(f"i{a}") for i, a in enumerate("xyz"))).collect():
        near = [(sum((p[a] - c[f"c{a}"]) ** 2 for a in "xyz"), k) for k, c in centres.items() if all(p[f"i{a}"] == c[f"i{a}"] for a in "xyz")]
        assert whole[p["point_id"]] == min(near)[1]
    # points meet centroids in a stream, not in a join of buckets
    assert "mapInArrow" in cut._jdf.queryExecution().optimizedPlan().toString() or "MapInArrow" in cut._jdf.queryExecution().sparkPlan().toString()
