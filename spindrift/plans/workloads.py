"""The eleven workloads: seeded random inputs, one Spark plan a transaction batch, timed by section."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.joins import large
from spindrift.operators import fields, surface, trace
from spindrift.plans.session import MeshSession
from spindrift.sources.sinks import ResultLog

DEFAULT = tuple(f"w{k}" for k in range(1, 9))
ALL = tuple(f"w{k}" for k in range(1, 12))


@dataclass
class Inputs:
    """Random inputs within the mesh bounds; one seed gives one sequence."""

    bounds: Sequence[float]
    seed: int = 0
    rng: random.Random = field(init=False)

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)

    def point(self) -> tuple[float, float, float]:
        b = self.bounds
        return tuple(self.rng.uniform(b[2 * i], b[2 * i + 1]) for i in range(3))  # type: ignore[return-value]

    def points(self, n: int | None = None) -> list[tuple[float, float, float]]:
        return [self.point() for _ in range(self.rng.randint(1, 100) if n is None else n)]

    def line(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return self.point(), self.point()

    def plane(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return self.point(), tuple(self.rng.uniform(-1, 1) for _ in range(3))

    def box(self) -> tuple[list[float], list[float]]:
        a, b = self.point(), self.point()
        return [min(p) for p in zip(a, b, strict=True)], [max(p) for p in zip(a, b, strict=True)]

    def interval(self, low: float, high: float) -> tuple[float, float]:
        a, b = self.rng.uniform(low, high), self.rng.uniform(low, high)
        return min(a, b), max(a, b)

    def start_points(self, session: MeshSession, n: int = 1, attempts: int = 16) -> DataFrame:
        """Points that some cell holds, after at most ``attempts`` batches."""
        for _ in range(attempts):
            found = session.point_intersection(session.points(self.points(n)), misses=True).where("cell_id IS NOT NULL")
            if not found.isEmpty():
                return found
        raise LookupError("no point hit the mesh")

    def ids(self, session: MeshSession, n: int = 32) -> list[int]:
        """Distinct 1-based point ids; dense ids need only their number."""
        total = session.mesh.nodes.count()
        return sorted(self.rng.sample(range(1, total + 1), min(n, total)))


def reduced(hits: DataFrame, session: MeshSession, var: str, step: int) -> DataFrame:
    values = fields.of(session.mesh.cell_scalar, var, step).select("cell_id", "value")
    v = F.col("value")
    return hits.join(large(values), "cell_id").agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"))


def w1(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [
        ("point", reduced(s.point_intersection(i.points()), s, var, step)),
        ("line", reduced(s.line_intersection(*i.line()), s, var, step)),
        ("plane", reduced(s.plane_intersection(*i.plane()), s, var, step)),
    ]


def box_aggregate(s: MeshSession, lower: Sequence[float], upper: Sequence[float], var: str) -> DataFrame:
    """W2: mean, max and min over all frames of the cells in a box, in one job."""
    return fields.selection_aggregate(s.range_query_coord(lower, upper), s.mesh.cell_scalar, var)


def w2(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("box", box_aggregate(s, *i.box(), var))]


def seeded_surface(s: MeshSession, cell_id: int, var: str, step: int) -> DataFrame:
    """W3: isosurface at a cell's value through the cells within the largest neighbour difference of it."""
    value = s.point_query([cell_id], var, step)[0]
    spread = s.get_max_diffs(step).get(var, 0.0)
    near = s.range_query_var(value - spread, value + spread, var, step)
    return s.isosurface_from_submesh(near, var, value, step)


def w3(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("isosurface", seeded_surface(s, i.rng.randrange(s.get_cell_count()), var, step))]


def w4(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("advection", trace.advect(i.start_points(s, 32).drop("cell_id"), s.mesh, s.steps(), grid=s.grid))]


def w5(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("streamline", trace.streamlines(i.start_points(s, 32).drop("cell_id"), s.mesh, step, grid=s.grid))]


def w6(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("force", surface.surface_force(s.surface_cells_and_normals(), s.mesh.cell_scalar, s.resolve_w6_scalar((var, "P")), step))]


def w7(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("qcriterion", s.compute_qcriterion_roi(*i.box(), step=step))]


def w8(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("range", s.range_query_var(*i.interval(*s.var_value_range(var, step)), var, step))]


def w9(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    box = i.box()
    return [("elements", s.h5_element_ids_in_coordinate_range(*box) if s.is_h5_dataset() else s.cfd_element_ids_in_coordinate_range(*box))]


def w10(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    return [("statistics", s.frame_statistics(step=step) if s.is_h5_dataset() else s.cfd_frame_statistics(step=step))]


def w11(s: MeshSession, i: Inputs, var: str, step: int) -> list[tuple[str, DataFrame]]:
    ids = s._ids(i.ids(s), "point_id")
    return [("extrema", fields.projected_extrema(ids, s.mesh.cell_nodes, s.mesh.cell_scalar, var))]


WORKLOADS: dict[str, Callable[[MeshSession, Inputs, str, int], list[tuple[str, DataFrame]]]] = {n: globals()[n] for n in ALL}


def run(session: MeshSession, workloads: Sequence[str] = DEFAULT, duration: float = 60.0, seed: int = 0, var: str = "P", step: int | None = None, log: ResultLog | None = None) -> list[dict]:
    """Transactions of each workload until its window closes, at least one; a transaction under way is finished.

    The unit is a batch (up to 100 points, one box, 32 particles): a Spark job's fixed
    cost is paid once for it.
    """
    rows = []
    at = session._step(step)
    inputs = Inputs(session.get_mesh_bounds(), seed)
    for name in workloads:
        began, counts = time.monotonic(), {}
        while True:
            for operation, frame in WORKLOADS[name](session, inputs, var, at):
                frame.write.format("noop").mode("overwrite").save()
                counts[operation] = counts.get(operation, 0) + 1
            if time.monotonic() - began >= duration:
                break
        spent = time.monotonic() - began
        for operation, n in counts.items():
            row = {"dataset": session.dataset, "workload": name, "operation": operation, "transactions": n, "duration": spent, "step": at}
            rows.append(log.add(**row) if log else row)
    return rows
