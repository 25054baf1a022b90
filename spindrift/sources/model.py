"""The mesh data model: static topology, frames of scalars, and its partitioned store."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax")
_D, _L, _I, _S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


#: Tables of a mesh; dataset and zone, and step for frames, are partition columns of the store.
SCHEMAS = {
    "cells": _schema(cell_id=_L, cx=_D, cy=_D, cz=_D, **{b: _D for b in BOX}),
    "nodes": _schema(node_id=_L, x=_D, y=_D, z=_D),
    "cell_nodes": _schema(cell_id=_L, node_ids=T.ArrayType(_L)),
    "edges": _schema(cell_id=_L, neighbor_id=_L),
    "boundary_faces": _schema(face_id=_L, cell_id=_L, patch=_S, nx=_D, ny=_D, nz=_D, area=_D, cx=_D, cy=_D, cz=_D),
    "cell_source": _schema(cell_id=_L, source_label=_L),
    "node_source": _schema(node_id=_L, source_label=_L),
    "cell_scalar": _schema(step=_I, var=_S, cell_id=_L, value=_D),
    "node_scalar": _schema(step=_I, var=_S, node_id=_L, value=_D),
}
FRAMES = ("cell_scalar", "node_scalar")


@dataclass(frozen=True)
class Mesh:
    """DataFrames of one zone; tables a source lacks are empty."""

    cells: DataFrame
    nodes: DataFrame
    cell_nodes: DataFrame
    edges: DataFrame
    boundary_faces: DataFrame
    cell_source: DataFrame
    node_source: DataFrame
    cell_scalar: DataFrame
    node_scalar: DataFrame
    meta: dict = field(default_factory=dict)

    @staticmethod
    def of(spark: SparkSession, meta: dict | None = None, **tables: DataFrame) -> Mesh:
        empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in tables}
        return Mesh(**tables, **empty, meta=meta or {})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "meta"}

    def at(self, step: int) -> Mesh:
        """The mesh with scalars of one frame; a pruned partition in the store."""
        return replace(self, cell_scalar=self.cell_scalar.where(F.col("step") == step), node_scalar=self.node_scalar.where(F.col("step") == step))


def zone_token(name: str) -> str:
    return name.strip().replace(" ", "_")


def write_mesh(mesh: Mesh, root: str, dataset: str, zone: str) -> None:
    """Replace the zone's topology and the written frames; other zones and frames stay.

    A table without rows leaves none of the zone's former rows, and a frame that one
    scalar table has now is no longer read from the other's former rows.  Scalars that
    are not finite become NULL here, so that every aggregate skips them.  Tables are
    sorted by entity id inside files, which lets id ranges skip row groups.
    """
    spark = mesh.cells.sparkSession
    held = {name: {r[0] for r in getattr(mesh, name).select("step").distinct().collect()} for name in FRAMES}
    for name, df in mesh.tables().items():
        keyed = df.withColumn("dataset", F.lit(dataset)).withColumn("zone", F.lit(zone_token(zone)))
        parts = ["dataset", "zone"]
        if name in FRAMES:
            entity = "cell_id" if name == "cell_scalar" else "node_id"
            from spindrift.functions.geometry import finite

            keyed = keyed.withColumn("value", finite(F.col("value")))
            keyed = keyed.repartitionByRange("step", entity).sortWithinPartitions("step", "var", entity)
            parts.append("step")
        elif "cell_id" in df.columns or "node_id" in df.columns:
            keyed = keyed.sortWithinPartitions("cell_id" if "cell_id" in df.columns else "node_id")
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{root}/{name}")
        # overwriting by partition leaves those alone that get no rows
        if name in FRAMES:
            stale = [{"step": s} for s in sorted(set().union(*held.values()) - held[name])]
        else:
            stale = [{}] if df.isEmpty() else []
        for keys in stale:
            _drop_partition(spark, f"{root}/{name}", {"dataset": dataset, "zone": zone_token(zone), **keys})


def _drop_partition(spark: SparkSession, path: str, keys: dict[str, str | int]) -> None:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    where = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{k}={escape(str(v))}" for k, v in keys.items())]))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    keys = [T.StructField("dataset", _S), T.StructField("zone", _S)]
    named = SCHEMAS[name].fields
    parts = [f for f in named if name in FRAMES and f.name == "step"]
    return spark.read.schema(T.StructType([f for f in named if f not in parts] + keys + parts)).parquet(f"{root}/{name}")


def read_mesh(spark: SparkSession, root: str, dataset: str, zone: str) -> Mesh:
    """Lazily filtered tables of a stored zone; filters prune partitions."""
    found = {}
    for name, schema in SCHEMAS.items():
        rows = read_table(spark, root, name).where((F.col("dataset") == dataset) & (F.col("zone") == zone_token(zone)))
        found[name] = rows.select(*schema.fieldNames())
    return Mesh(**found, meta={"dataset": dataset, "zone": zone_token(zone)})


def register_tables(spark: SparkSession, root: str, database: str = "mesh") -> None:
    """External tables over a store, partitioned as it is, for ``spark.sql``; safe to repeat."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in SCHEMAS.items():
        keys = {"dataset": "STRING", "zone": "STRING"} | ({"step": "INT"} if name in FRAMES else {})
        columns = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in keys] + [f"`{k}` {t}" for k, t in keys.items()])
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet PARTITIONED BY ({', '.join(keys)}) LOCATION '{root}/{name}'")
        spark.sql(f"MSCK REPAIR TABLE `{database}`.`{name}`")


def discover(cell_scalar: DataFrame) -> DataFrame:
    """(dataset, zone, steps, variables): the frames of each zone and the variables present in all of them."""
    seen = cell_scalar.groupBy("dataset", "zone", "step", "var").agg(F.count(F.lit(1)).alias("n"))
    frames = seen.groupBy("dataset", "zone").agg(F.array_sort(F.collect_set("step")).alias("steps"))
    shown = seen.groupBy("dataset", "zone", "var").agg(F.count(F.lit(1)).alias("frames"))
    full = shown.join(frames, ["dataset", "zone"]).where(F.col("frames") == F.size("steps"))
    variables = full.groupBy("dataset", "zone").agg(F.array_sort(F.collect_set("var")).alias("variables"))
    return frames.join(variables, ["dataset", "zone"], "left").select("dataset", "zone", "steps", F.coalesce("variables", F.array().cast("array<string>")).alias("variables"))


def preferred_zone(zones: list[str], preferred: str | None = None) -> str:
    """Preferred, else 0_Fluid, else the first named like a fluid, else the first."""
    names = sorted(zones)
    if preferred in names:
        return preferred  # type: ignore[return-value]
    if "0_Fluid" in names:
        return "0_Fluid"
    return next((z for z in names if "fluid" in z.lower()), names[0])


def surface_zone_order(zones: list[str], preferred: str | None = None, hint: str | None = None) -> list[str]:
    """Zones to try for surface integrals: hint, hull, wall, symmetry, any but fluid, preferred, the rest."""
    tests = [lambda z: z == hint, lambda z: "hull" in z.lower(), lambda z: "wall" in z.lower(), lambda z: "symmetry" in z.lower(), lambda z: "fluid" not in z.lower(), lambda z: z == preferred, lambda z: True]
    out: list[str] = []
    for test in tests:
        out += [z for z in sorted(zones) if test(z) and z not in out]
    return out
