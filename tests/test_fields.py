from __future__ import annotations

import math

import pytest

from spindrift.operators import fields
from tests.meshes import mesh


@pytest.fixture(scope="module")
def chain(spark):
    """Three line cells in a row with two frames."""
    scalars = [(s, "P", k, 2 * k + 2 * s) for s in (0, 1) for k in range(3)] + [(0, "Q", 0, float("nan")), (0, "Q", 1, 5.0)]
    nodal = [(0, "T", k, k) for k in range(4)] + [(1, "T", k, 10 - k) for k in range(4)] + [(0, "P", 0, 1.0)]
    return mesh(spark, [(k, 0, 0) for k in range(4)], [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2)], scalars, nodal)


def test_point_query_keeps_order_duplicates_and_misses(spark, chain):
    ask = spark.createDataFrame(list(enumerate([2, 9, 0, 2])), "ord long, cell_id long")
    rows = fields.point_query(ask, chain.cell_scalar, "P", 1, missing_nan=True).orderBy("ord").collect()
    values = [r["value"] for r in rows]
    assert values[0] == 6 and math.isnan(values[1]) and values[2:] == [2, 6]


def test_range_var_bounds(chain):
    ids = lambda **k: sorted(r[0] for r in fields.range_var(chain.cell_scalar, "P", step=0, **k).collect())
    assert ids(lower=2, upper=4) == [1, 2]
    assert ids(lower=4, upper=2) == []
    assert ids(lower=4, upper=2, normalize=True) == [1, 2]
    assert [r[0] for r in fields.range_var(chain.cell_scalar, "Q", -1e9, 1e300, 0).collect()] == [1]


def test_projection_to_nodes_gives_known_extrema(spark, chain):
    ask = spark.createDataFrame([(3,), (4,), (99,), (3,)], "point_id long")
    rows = fields.projected_extrema(ask, chain.cell_nodes, chain.cell_scalar, "P").collect()
    assert {r["point_id"]: (r["min"], r["max"]) for r in rows} == {3: (3, 5), 4: (4, 6)}


def test_nodal_extrema(spark, chain):
    ask = spark.createDataFrame([(101,), (103,), (7,)], "source_label long")
    rows = fields.nodal_extrema(ask, chain.node_source, chain.node_scalar, "T").collect()
    assert {r["source_label"]: (r["min"], r["max"]) for r in rows} == {101: (1, 9), 103: (3, 7)}


def test_statistics_skip_what_is_not_finite_and_prefer_nodes(chain):
    rows = {(r["step"], r["var"]): r for r in fields.frame_statistics(chain.cell_scalar, chain.node_scalar).collect()}
    assert rows[0, "Q"]["count"] == 1 and rows[0, "Q"]["mean"] == 5 and rows[0, "Q"]["stddev"] == 0
    assert rows[0, "P"]["position"] == "node" and rows[1, "P"]["position"] == "cell"
    assert rows[1, "P"]["stddev"] == pytest.approx(math.sqrt(8 / 3))


def test_common_variables_and_ranges(chain):
    assert [r[0] for r in fields.common_variables(chain.cell_scalar).collect()] == ["P"]
    r = fields.value_range(chain.cell_scalar, "Q", 0).first()
    assert (r["min"], r["max"]) == (5, 5)


def test_max_neighbor_diff_and_fallbacks(chain):
    got = {(r["step"], r["var"]): r["max_diff"] for r in fields.max_neighbor_diff(chain.edges, chain.cell_scalar).collect()}
    assert got[0, "P"] == 2 and got[0, "Q"] == 0
    spans = {(r["step"], r["var"]): r["max_diff"] for r in fields.max_neighbor_diff(chain.edges.where("false"), chain.cell_scalar, "range").collect()}
    assert spans[1, "P"] == 4


def test_selection_aggregate(spark, chain):
    chosen = spark.createDataFrame([(0,), (2,), (2,)], "cell_id long")
    r = fields.selection_aggregate(chosen, chain.cell_scalar, "P").first()
    assert (r["count"], r["sum"], r["min"], r["max"], r["mean"]) == (4, 12, 0, 6, 3)


def test_element_ids(chain):
    assert sorted(r[0] for r in fields.element_ids_in_range(chain.cells, (0, -1, -1), (2, 1, 1)).collect()) == [1, 2]
    assert sorted(r[0] for r in fields.element_ids_in_range(chain.cells, (0, -1, -1), (2, 1, 1), chain.cell_source).collect()) == [500, 501]
    assert fields.element_ids_in_range(chain.cells, (2, 1, 1), (0, -1, -1)).count() == 0


def test_id_lookup_filters_reach_the_scan(spark, sf_dir, tmp_path, chain):
    from spindrift.sources.model import read_mesh, write_mesh

    write_mesh(chain, str(tmp_path / "m"), "d", "z")
    stored = read_mesh(spark, str(tmp_path / "m"), "d", "z")
    plan = fields.of(stored.cell_scalar, "P", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "step" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(var,P)" in plan
