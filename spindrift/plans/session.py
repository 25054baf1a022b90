"""The client surface: one object for a dataset, zone and frame, answering with DataFrames or small arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import plane_hit, segment_entry
from spindrift.functions.storage import materialize
from spindrift.operators import fields, gradient, interpolate, locate, shells, surface
from spindrift.sources.derived import read_derived
from spindrift.sources.model import Mesh, discover, read_table, surface_zone_order, zone_token


class MeshSession:
    """Lazy queries on a mesh at a default frame.

    Methods that return ids or rows give DataFrames; single numbers come as Python
    values.  ``h5`` methods use source labels and nodal values, ``cfd`` methods
    1-based ids and cell values.  ``store`` is the folder the mesh was read from, if
    any: results stored there are read instead of computed again.
    """

    def __init__(self, mesh: Mesh, step: int | None = None, dataset: str = "", zone: str = "0_Fluid", store: str | None = None) -> None:
        self.mesh, self.step, self.dataset, self.zone, self.store = mesh, step, dataset, zone, store

    @property
    def spark(self):  # noqa: ANN201
        return self.mesh.cells.sparkSession

    def _step(self, step: int | None) -> int:
        chosen = self.step if step is None else step
        if chosen is None:
            raise ValueError("no step is chosen")
        return chosen

    def _ids(self, ids: Sequence[int], name: str = "cell_id") -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(map(int, ids))), f"ord long, {name} long")

    @cached_property
    def capabilities(self) -> dict[str, bool]:
        """Which tables hold anything; each probe reads one row."""
        return {name: not df.limit(1).isEmpty() for name, df in self.mesh.tables().items()}

    @cached_property
    def grid(self) -> locate.Grid:
        return locate.grid_of(self.mesh.cells)

    def _derived(self, name: str, step: int) -> DataFrame | None:
        """Stored rows of a frame; None where the store has none."""
        rows = None if self.store is None else read_derived(self.spark, self.store, name, self.dataset, self.zone)
        rows = None if rows is None else rows.where(F.col("step") == step)
        return None if rows is None or rows.isEmpty() else rows

    @cached_property
    def _zones(self) -> dict[str, list[str]]:
        """Variables present in all frames of each zone of the data set; of this zone alone without a store."""
        if self.store is None:
            return {self.zone: self.cfd_variables()}
        stored = read_table(self.spark, self.store, "cell_scalar").where(F.col("dataset") == self.dataset)
        named = {r["zone"]: list(r["variables"]) for r in discover(stored).collect()}
        shaped = read_table(self.spark, self.store, "cells").where(F.col("dataset") == self.dataset).select("zone").distinct().collect()
        return {r["zone"]: named.get(r["zone"], []) for r in shaped}

    def list_zones(self) -> list[str]:
        return sorted(self._zones)

    def variables_for_zone(self, zone: str | None = None) -> tuple[str, ...]:
        return tuple(sorted(self._zones.get(self.zone if zone is None else zone_token(zone), ())))

    def resolve_hull_zone(self, hint: str | None = None) -> str:
        """The zone to integrate over the surface of."""
        return surface_zone_order(self.list_zones(), self.zone, hint)[0]

    def is_h5_dataset(self) -> bool:
        return self.capabilities["node_source"]

    def steps(self) -> list[int]:
        return [r[0] for r in self.mesh.cell_scalar.select("step").distinct().orderBy("step").collect()]

    def get_mesh_bounds(self, of_centroids: bool = False) -> list[float]:
        b = fields.mesh_bounds(self.mesh.cells, of_centroids).first()
        return [b[f"{a}{s}"] for a in "xyz" for s in ("min", "max")]

    def get_cell_count(self) -> int:
        return self.mesh.cells.count()

    def point_query(self, cell_ids: Sequence[int], var: str, step: int | None = None) -> list[float]:
        rows = fields.point_query(self._ids(cell_ids), self.mesh.cell_scalar, var, self._step(step), missing_nan=True).orderBy("ord").collect()
        return [r["value"] for r in rows]

    bulk_point_query = point_query

    def contiguous_point_query(self, first: int, last: int, var: str, step: int | None = None) -> DataFrame:
        return fields.contiguous_query(self.mesh.cell_scalar, var, self._step(step), first, last)

    def aggregate_point_query(self, cell_ids: Sequence[int], var: str, step: int | None = None) -> tuple[int, float, float, float]:
        r = fields.selection_aggregate(self._ids(cell_ids), self.mesh.cell_scalar, var, [self._step(step)]).first()
        return r["count"], r["sum"], r["min"], r["max"]

    def velocity_query(self, cell_ids: Sequence[int], step: int | None = None) -> list[tuple[float, float, float]]:
        rows = fields.velocity_query(self._ids(cell_ids), self.mesh.cell_scalar, self._step(step)).orderBy("ord").collect()
        return [tuple(math.nan if r[v] is None else r[v] for v in fields.VELOCITY) for r in rows]  # type: ignore[misc]

    def range_query_var(self, lower: float, upper: float, var: str, step: int | None = None, normalize: bool = False) -> DataFrame:
        return fields.range_var(self.mesh.cell_scalar, var, lower, upper, self._step(step), normalize).orderBy("cell_id")

    def range_query_coord(self, lower: Sequence[float], upper: Sequence[float], mode: str = "aabb") -> DataFrame:
        return fields.range_coord(self.mesh.cells, lower, upper, mode).orderBy("cell_id")

    def points(self, points: Sequence[Sequence[float]]) -> DataFrame:
        return self.spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "point_id long, x double, y double, z double")

    def point_intersection(self, points: Sequence[Sequence[float]] | DataFrame, mode: str = "nearest", misses: bool = False) -> DataFrame:
        """Cells of points; misses are left out unless asked for.

        Modes: nearest, first and nearest_in_bucket decide by boxes, exact by the cells' convex shells.
        """
        table = points if isinstance(points, DataFrame) else self.points(points)
        if mode == "exact":
            return shells.locate_exact(table, self.mesh, self.grid, misses).orderBy("point_id")
        found = {"nearest": locate.locate_nearest, "first": locate.locate_first, "nearest_in_bucket": locate.locate_nearest_in_bucket}[mode]
        return found(table, self.mesh.cells, misses=misses).orderBy("point_id")

    def line_intersection(self, start: Sequence[float], end: Sequence[float], mode: str = "box") -> DataFrame:
        """(cell_id, t) along the segment of the cells whose box, or whose convex shell with ``exact``, it meets."""
        if mode == "exact":
            return shells.segment_cells(self.mesh, start, end).orderBy("t", "cell_id")
        return self.mesh.cells.select("cell_id", segment_entry(start, end).alias("t")).where("t IS NOT NULL").orderBy("t", "cell_id")

    def plane_intersection(self, origin: Sequence[float], normal: Sequence[float], zero_normal: str = "empty") -> DataFrame:
        return self.mesh.cells.where(plane_hit(origin, normal, zero_normal=zero_normal)).select("cell_id").orderBy("cell_id")

    def extract_submesh(self, selection: DataFrame | Sequence[int]) -> dict[str, DataFrame]:
        return surface.extract_submesh(self.mesh, selection if isinstance(selection, DataFrame) else self._ids(selection))

    def isosurface_extraction(self, var: str, iso: float, step: int | None = None, node_values: str = "projected") -> DataFrame:
        return surface.isosurface(self.mesh, var, iso, self._step(step), node_values=node_values)

    def isosurface_from_submesh(self, selection: DataFrame, var: str, iso: float, step: int | None = None, node_values: str = "projected") -> DataFrame:
        return surface.isosurface(self.mesh, var, iso, self._step(step), selection, node_values)

    def surface_norm(self, selection: DataFrame | None = None) -> DataFrame:
        return surface.surface_normals(self.mesh, selection) if selection is not None else surface.surface_cells_and_normals(self.mesh)

    def surface_cells_and_normals(self) -> DataFrame:
        return self._prepared["normals"] if "normals" in self._prepared else surface.surface_cells_and_normals(self.mesh)

    @cached_property
    def _prepared(self) -> dict[str, DataFrame]:
        return {}

    def prepare_surface_force_query(self) -> bool:
        """Write the surface normals once for the force queries that follow; False where there is no surface."""
        if "normals" not in self._prepared:
            self._prepared["normals"] = materialize(surface.surface_cells_and_normals(self.mesh), "session-normals")
        return not self._prepared["normals"].isEmpty()

    def prepare_cfd_point_queries(self) -> None:
        """Write the nodes' cells once, dealt by node, for the point queries that follow."""
        if "incidence" not in self._prepared:
            pairs = fields.incidence(self.mesh.cell_nodes).repartition("node_id").sortWithinPartitions("node_id")
            self._prepared["incidence"] = materialize(pairs, "session-incidence")

    def surface_force_query(self, var: str, step: int | None = None) -> tuple[float, float, float] | None:
        r = surface.surface_force(self.surface_cells_and_normals(), self.mesh.cell_scalar, var, self._step(step)).first()
        return None if r is None else (r["fx"], r["fy"], r["fz"])

    def compute_qcriterion_roi(self, lower: Sequence[float], upper: Sequence[float], tau: float | None = None, step: int | None = None, **options) -> DataFrame:
        return gradient.q_criterion(self.mesh, lower, upper, self._step(step), tau, **options).orderBy("cell_id")

    def query_vortex_cells(self, tau: float, lower: Sequence[float], upper: Sequence[float], step: int | None = None, **options) -> DataFrame:
        """(cell_id, q), strongest first; of stored values where the frame has them and no option changes them."""
        stored = None if options else self._derived("qcriterion", self._step(step))
        if stored is None:
            return gradient.vortex_cells(self.mesh, lower, upper, self._step(step), tau, **options)
        inside = stored.where(F.col("q") >= tau).join(fields.range_coord(self.mesh.cells, lower, upper), "cell_id", "left_semi")
        return inside.select("cell_id", "q").orderBy(F.desc("q"), "cell_id")

    def var_value_range(self, var: str, step: int | None = None) -> tuple[float, float]:
        """(0, 1) for a variable without finite values."""
        r = fields.value_range(self.mesh.cell_scalar, var, self._step(step)).first()
        return (0.0, 1.0) if r is None or r["min"] is None else (r["min"], r["max"])

    def get_max_diffs(self, step: int | None = None) -> dict[str, float]:
        """Stored differences, else computed ones, which are max - min where no neighbours have values."""
        rows = self._derived("max_diffs", self._step(step))
        if rows is None:
            rows = fields.max_neighbor_diff(self.mesh.edges, fields.of(self.mesh.cell_scalar, step=self._step(step)), "range")
        return {r["var"]: r["max_diff"] for r in rows.collect()}

    def h5_element_ids_in_coordinate_range(self, lower: Sequence[float], upper: Sequence[float]) -> DataFrame:
        return fields.element_ids_in_range(self.mesh.cells, lower, upper, self.mesh.cell_source).orderBy("element_id")

    def cfd_element_ids_in_coordinate_range(self, lower: Sequence[float], upper: Sequence[float]) -> DataFrame:
        return fields.element_ids_in_range(self.mesh.cells, lower, upper).orderBy("element_id")

    def frame_statistics(self, var: str | None = None, step: int | None = None) -> DataFrame:
        return self._filled(fields.frame_statistics(self.mesh.cell_scalar, self.mesh.node_scalar, var, self._step(step)))

    def cfd_frame_statistics(self, var: str | None = None, step: int | None = None) -> DataFrame:
        return self._filled(fields.frame_statistics(self.mesh.cell_scalar, None, var, self._step(step)))

    @staticmethod
    def _filled(stats: DataFrame) -> DataFrame:
        if stats.limit(1).isEmpty():
            raise ValueError("the frame has no finite values")
        return stats

    def h5_nodal_variables(self) -> list[str]:
        return sorted(r[0] for r in fields.common_variables(self.mesh.node_scalar).collect())

    def cfd_variables(self) -> list[str]:
        return sorted(r[0] for r in fields.common_variables(self.mesh.cell_scalar).collect())

    def h5_point_ids(self) -> DataFrame:
        return self.mesh.node_source.select("source_label").orderBy("source_label")

    def cfd_point_ids(self) -> DataFrame:
        return self.mesh.nodes.select((F.col("node_id") + 1).alias("point_id")).orderBy("point_id")

    def h5_point_frame_extrema(self, labels: Sequence[int], var: str) -> dict[int, tuple[float, float]]:
        rows = fields.nodal_extrema(self._ids(labels, "source_label"), self.mesh.node_source, self.mesh.node_scalar, var).collect()
        return {r["source_label"]: (r["min"], r["max"]) for r in rows}

    def cfd_point_frame_extrema(self, ids: Sequence[int], var: str) -> dict[int, tuple[float, float]]:
        rows = fields.projected_extrema(self._ids(ids, "point_id"), self.mesh.cell_nodes, self.mesh.cell_scalar, var, self._prepared.get("incidence")).collect()
        return {r["point_id"]: (r["min"], r["max"]) for r in rows}

    def resolve_w6_scalar(self, candidates: Sequence[str] = ("P",)) -> str:
        """The first candidate that the frame has, else its first variable."""
        held = {r[0] for r in fields.of(self.mesh.cell_scalar, step=self.step).select("var").distinct().collect()}
        chosen = next((c for c in candidates if c in held), min(held, default=None))
        if chosen is None:
            raise ValueError("the frame has no variable")
        return chosen

    @staticmethod
    def w6_zone_candidates(zones: Sequence[str], preferred: str | None = None, hint: str | None = None) -> list[str]:
        return surface_zone_order(list(zones), preferred, hint)

    def interpolate(self, target: Sequence[float], variables: Sequence[str] | None = None, step: int | None = None) -> dict:
        return interpolate.interpolate(self.mesh, target, variables or self.cfd_variables(), self._step(step))

    def couple(self, points: DataFrame, variables: Sequence[str] | None = None, step: int | None = None) -> DataFrame:
        return interpolate.couple(points, self.mesh, variables or self.cfd_variables(), self._step(step), self.grid)
