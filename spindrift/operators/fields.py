"""Lookups, ranges and aggregates over frames of scalars.

Scalars are long tables (step, var, entity, value).  Filters on step and var reach
the scan (step is a partition of the store), aggregates are partial before they
are final, and id lists join as tables instead of growing predicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import box_in_box, finite, ordered, point_in_box
from spindrift.functions.joins import large

VELOCITY = ("U", "V", "W")


def of(scalars: DataFrame, var: str | None = None, step: int | None = None) -> DataFrame:
    kept = scalars if step is None else scalars.where(F.col("step") == step)
    return kept if var is None else kept.where(F.col("var") == var)


def wide(scalars: DataFrame, variables: Sequence[str], entity: str = "cell_id") -> DataFrame:
    """(step, entity, one column a variable); the list is explicit, so no extra pass looks for values."""
    picks = [F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in variables]
    return scalars.where(F.col("var").isin(*variables)).groupBy("step", entity).agg(*picks)


def point_query(requests: DataFrame, cell_scalar: DataFrame, var: str, step: int, missing_nan: bool = False) -> DataFrame:
    """``requests`` (ord, cell_id) with ``value``; each request keeps its row, duplicates and misses included."""
    values = of(cell_scalar, var, step).select("cell_id", "value")
    found = requests.join(values, "cell_id", "left").select("ord", "cell_id", "value")
    return found.withColumn("value", F.coalesce("value", F.lit(float("nan")))) if missing_nan else found


def contiguous_query(cell_scalar: DataFrame, var: str, step: int, first: int, last: int) -> DataFrame:
    """A dense id range as a range predicate, which skips row groups of files sorted by id."""
    return of(cell_scalar, var, step).where(F.col("cell_id").between(first, last)).select("cell_id", "value")


def matrix_query(requests: DataFrame, cell_scalar: DataFrame, variables: Sequence[str], step: int) -> DataFrame:
    """Several variables of each request with one scan."""
    return requests.join(wide(of(cell_scalar, step=step), variables).drop("step"), "cell_id", "left").select("ord", "cell_id", *variables)


def velocity(cell_scalar: DataFrame, step: int | None = None) -> DataFrame:
    """(step, cell_id, U, V, W) of cells that have all three finite components."""
    kept = wide(of(cell_scalar, step=step).withColumn("value", finite(F.col("value"))), VELOCITY)
    return kept.dropna(subset=list(VELOCITY))


def velocity_query(requests: DataFrame, cell_scalar: DataFrame, step: int) -> DataFrame:
    """All three components, or none where any is missing."""
    return requests.join(velocity(cell_scalar, step).drop("step"), "cell_id", "left").select("ord", "cell_id", *VELOCITY)


def range_var(cell_scalar: DataFrame, var: str, lower: float, upper: float, step: int, normalize: bool = False) -> DataFrame:
    """Cells whose value is in the closed interval; NaN never is.  ``normalize`` sorts the bounds."""
    if normalize:
        lower, upper = min(lower, upper), max(lower, upper)
    inside = F.col("value").between(lower, upper) & ~F.isnan("value")
    return of(cell_scalar, var, step).where(inside).select("cell_id")


def range_coord(cells: DataFrame, lower: Sequence[float], upper: Sequence[float], mode: str = "aabb") -> DataFrame:
    """Cells in a box by their own box (``aabb``) or their centroid (``centroid``); bounds in either order."""
    if mode == "aabb":
        return cells.where(box_in_box(lower, upper)).select("cell_id")
    if mode == "centroid":
        lo, hi = ordered(lower, upper)
        return cells.where(point_in_box([F.col(f"c{a}") for a in "xyz"], lo, hi)).select("cell_id")
    raise ValueError(f"unknown mode {mode!r}")


def element_ids_in_range(cells: DataFrame, lower: Sequence[float], upper: Sequence[float], sources: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """Source element ids with centroids in a box: labels of ``sources``, or cell_id + 1."""
    lo, hi = ordered(lower, upper) if normalize else (list(lower), list(upper))
    inside = cells.where(point_in_box([F.col(f"c{a}") for a in "xyz"], lo, hi)).select("cell_id")
    if sources is None:
        return inside.select((F.col("cell_id") + 1).alias("element_id"))
    return inside.join(sources, "cell_id").select(F.col("source_label").alias("element_id"))


def _statistics(scalars: DataFrame, position: str) -> DataFrame:
    v = finite(F.col("value"))
    return scalars.groupBy("step", "var").agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev")
    ).where("count > 0").withColumn("position", F.lit(position))


def frame_statistics(cell_scalar: DataFrame, node_scalar: DataFrame | None = None, var: str | None = None, step: int | None = None) -> DataFrame:
    """count, min, max, mean, population stddev of finite values for each frame and variable.

    With nodal scalars, a variable that has them is reported at nodes, others at cells.
    """
    at_cells = _statistics(of(cell_scalar, var, step), "cell")
    if node_scalar is None:
        return at_cells
    at_nodes = _statistics(of(node_scalar, var, step), "node")
    # frames and variables with a finite nodal value, without computing their statistics again
    nodal = of(node_scalar, var, step).where(finite(F.col("value")).isNotNull()).select("step", "var").distinct()
    return at_nodes.unionByName(at_cells.join(nodal, ["step", "var"], "left_anti"))


def nodal_extrema(requests: DataFrame, node_source: DataFrame, node_scalar: DataFrame, var: str) -> DataFrame:
    """(source_label, min, max) over all frames of the requested node labels."""
    ids = requests.select("source_label").distinct().join(node_source, "source_label")
    values = of(node_scalar, var).join(ids, "node_id").select("source_label", finite(F.col("value")).alias("v"))
    return values.groupBy("source_label").agg(F.min("v").alias("min"), F.max("v").alias("max")).where("min IS NOT NULL")


def incidence(cell_nodes: DataFrame) -> DataFrame:
    """(node_id, cell_id), the reverse of the connectivity."""
    return cell_nodes.select("cell_id", F.explode("node_ids").alias("node_id")).distinct()


def node_projection(cell_nodes: DataFrame, cell_scalar: DataFrame, nodes: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(step, var, node_id, value): mean of the finite values of a node's cells.

    ``nodes`` (node_id) restricts the incidence before scalars are joined; ``pairs``
    is the incidence, for callers that keep it.
    """
    pairs = incidence(cell_nodes) if pairs is None else pairs
    pairs = pairs if nodes is None else pairs.join(large(nodes.select("node_id").distinct()), "node_id", "left_semi")
    values = cell_scalar.select("step", "var", "cell_id", finite(F.col("value")).alias("v")).where("v IS NOT NULL")
    return pairs.join(large(values), "cell_id").groupBy("step", "var", "node_id").agg(F.avg("v").alias("value"))


def projected_extrema(requests: DataFrame, cell_nodes: DataFrame, cell_scalar: DataFrame, var: str, pairs: DataFrame | None = None) -> DataFrame:
    """(point_id, min, max) over frames of cell values projected to the requested 1-based points; unknown ids are omitted."""
    nodes = requests.select((F.col("point_id") - 1).alias("node_id"))
    means = node_projection(cell_nodes, of(cell_scalar, var), nodes, pairs)
    return means.groupBy((F.col("node_id") + 1).alias("point_id")).agg(F.min("value").alias("min"), F.max("value").alias("max"))


def selection_aggregate(selection: DataFrame, cell_scalar: DataFrame, var: str, steps: Sequence[int] | None = None) -> DataFrame:
    """count, sum, mean, min, max of the finite values of the selected cells over all or the given frames."""
    kept = of(cell_scalar, var)
    kept = kept if steps is None else kept.where(F.col("step").isin(*steps))
    v = finite(F.col("value"))
    return kept.join(selection.select("cell_id").distinct(), "cell_id", "left_semi").agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def value_range(cell_scalar: DataFrame, var: str | None = None, step: int | None = None) -> DataFrame:
    v = finite(F.col("value"))
    return of(cell_scalar, var, step).groupBy("step", "var").agg(F.min(v).alias("min"), F.max(v).alias("max"))


def mesh_bounds(cells: DataFrame, of_centroids: bool = False) -> DataFrame:
    """One row: xmin..zmax and n_cells, of the cells' boxes or of their centroids."""
    sides = [(F.min(f"c{a}" if of_centroids else f"{a}min").alias(f"{a}min"), F.max(f"c{a}" if of_centroids else f"{a}max").alias(f"{a}max")) for a in "xyz"]
    return cells.agg(*(s for pair in sides for s in pair), F.count(F.lit(1)).alias("n_cells"))


def common_variables(scalars: DataFrame) -> DataFrame:
    """Variables present in every frame."""
    seen = scalars.groupBy("step", "var").agg(F.count(F.lit(1)).alias("n"))
    frames = seen.agg(F.countDistinct("step").alias("frames"))
    held = seen.groupBy("var").agg(F.count(F.lit(1)).alias("held"))
    return held.join(F.broadcast(frames), F.col("held") == F.col("frames")).select("var")  # one row


def max_neighbor_diff(edges: DataFrame, cell_scalar: DataFrame, fallback: str = "zero") -> DataFrame:
    """(step, var, max_diff): largest absolute difference between neighbouring cells.

    ``fallback`` for frames without a pair: ``zero``, or ``range`` for max - min.
    """
    once = edges.where("cell_id < neighbor_id").distinct()
    v = cell_scalar.select("step", "var", "cell_id", finite(F.col("value")).alias("value")).where("value IS NOT NULL")
    a = once.join(v.withColumnRenamed("value", "va"), "cell_id")
    b = v.select("step", "var", F.col("cell_id").alias("neighbor_id"), F.col("value").alias("vb"))
    diffs = a.join(b, ["step", "var", "neighbor_id"]).groupBy("step", "var").agg(F.max(F.abs(F.col("va") - F.col("vb"))).alias("d"))
    spans = v.groupBy("step", "var").agg((F.max("value") - F.min("value")).alias("span"))
    other: Column = F.col("span") if fallback == "range" else F.lit(0.0)
    return spans.join(diffs, ["step", "var"], "left").select("step", "var", F.coalesce("d", other).alias("max_diff"))
