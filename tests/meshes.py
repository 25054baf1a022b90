"""Literal meshes of the tests."""

from __future__ import annotations

import itertools

from pyspark.sql import SparkSession

from spindrift.operators.topology import cells_from_nodes
from spindrift.sources.model import SCHEMAS, Mesh


def mesh(spark: SparkSession, nodes: list, cell_nodes: list, edges: list = (), scalars: list = (), node_scalars: list = ()) -> Mesh:
    make = lambda rows, name: spark.createDataFrame(list(rows), SCHEMAS[name])
    n = make([(k, *map(float, p)) for k, p in enumerate(nodes)], "nodes")
    c = make([(k, list(ids)) for k, ids in enumerate(cell_nodes)], "cell_nodes")
    return Mesh.of(
        spark, nodes=n, cell_nodes=c, cells=cells_from_nodes(c, n), edges=make([(a, b) for p in edges for a, b in (p, p[::-1])], "edges"),
        cell_scalar=make([(s, v, k, None if x is None else float(x)) for s, v, k, x in scalars], "cell_scalar"), node_scalar=make([(s, v, k, float(x)) for s, v, k, x in node_scalars], "node_scalar"),
        node_source=make([(k, 100 + k) for k in range(len(nodes))], "node_source"), cell_source=make([(k, 500 + k) for k in range(len(cell_nodes))], "cell_source"),
    )


TETRA = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
CUBE = [(x, y, z) for x, y, z in itertools.product((0, 1), repeat=3)]


def boxes(n: int = 200) -> list[tuple]:
    """The box lattice of the predicate tests: id, centroid, box of side 0.8."""
    out = []
    for k in range(n):
        at = (k % 20, (k // 20) % 10, k // 200)
        out.append((k, *(float(v) + 0.4 for v in at), *(e for v in at for e in (float(v), v + 0.8))))
    return out


def box_cells(spark: SparkSession, n: int = 200):  # noqa: ANN201
    return spark.createDataFrame(boxes(n), SCHEMAS["cells"])
