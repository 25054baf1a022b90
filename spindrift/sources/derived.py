"""Results stored beside a mesh: largest neighbour differences and Q-criterion by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators.fields import max_neighbor_diff
from spindrift.operators.gradient import q_criterion
from spindrift.sources.model import Mesh, zone_token

SCHEMAS = {
    "max_diffs": "var string, max_diff double, dataset string, zone string, step int",
    "qcriterion": "cell_id long, q double, dataset string, zone string, step int",
}


def write_derived(rows: DataFrame, root: str, name: str, dataset: str, zone: str) -> None:
    """Replace the frames that ``rows`` (step, ...) holds; other frames, zones and data sets stay."""
    keyed = rows.withColumns({"dataset": F.lit(dataset), "zone": F.lit(zone_token(zone))})
    keyed = keyed.select(*T.StructType.fromDDL(SCHEMAS[name]).fieldNames())
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "zone", "step").parquet(f"{root}/{name}")


def read_derived(spark: SparkSession, root: str, name: str, dataset: str, zone: str) -> DataFrame | None:
    """Rows of a stored zone without its keys, or None where nothing was ever stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
    return rows.where((F.col("dataset") == dataset) & (F.col("zone") == zone_token(zone))).drop("dataset", "zone")


def store_max_diffs(mesh: Mesh, root: str, dataset: str, zone: str) -> None:
    """Largest neighbour differences of every frame and variable, max - min where no neighbours have values."""
    write_derived(max_neighbor_diff(mesh.edges, mesh.cell_scalar, "range"), root, "max_diffs", dataset, zone)


def store_qcriterion(mesh: Mesh, root: str, dataset: str, zone: str, step: int, **options) -> None:
    """Q of every cell of a frame, for threshold queries that then compute nothing."""
    inf = float("inf")
    rows = q_criterion(mesh, (-inf,) * 3, (inf,) * 3, step, **options).select("cell_id", "q", F.lit(step).cast("int").alias("step"))
    write_derived(rows, root, "qcriterion", dataset, zone)
