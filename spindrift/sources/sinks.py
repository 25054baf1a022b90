"""Small exports: coupling tables, max-diff files, benchmark rows and VTK XML grids."""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.geometry import finite
from spindrift.operators.interpolate import STATUS
from spindrift.operators.topology import vtk_cell_type
from spindrift.sources.model import Mesh


def write_coupling(coupled: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """The coupled table as parquet with one metadata row beside it; Spark's commit makes each appear at once."""
    coupled.write.mode("overwrite").parquet(f"{path}/points")
    rows = sorted((metadata or {}).items()) or [("", "")]
    coupled.sparkSession.createDataFrame(rows, "key string, value string").write.mode("overwrite").parquet(f"{path}/metadata")


def coupling_csv(coupled: DataFrame, path: str, variables: Sequence[str]) -> None:
    """Status names and numbers with the digits that read back as the same double; values that are not finite are empty."""
    names = F.array(*(F.lit(s) for s in STATUS))
    number = lambda c: F.when(finite(F.col(c)).isNotNull(), F.col(c).cast("string"))
    flat = coupled.select("point_id", *(number(a).alias(a) for a in "xyz"), F.get(names, F.col("status")).alias("status"), "cell_id", *(number(v).alias(v) for v in variables))
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_max_diffs(diffs: DataFrame, path: str) -> None:
    """(step, var, max_diff), one folder a step."""
    diffs.repartition("step").write.mode("overwrite").partitionBy("step").option("header", True).csv(path)


def read_max_diffs(spark, path: str) -> DataFrame:  # noqa: ANN001
    return spark.read.schema("var string, max_diff double, step int").option("header", True).csv(path)


@dataclass
class ResultLog:
    """Rows of a benchmark run; each is written and flushed when its section ends."""

    path: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    # The columns of a result file.
    COLUMNS = ("run_id", "timestamp_utc", "dataset", "workload", "backend", "operation", "step", "transactions", "duration_sec", "txns_per_sec", "details")

    def __post_init__(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "w", newline="") as f:
            csv.writer(f).writerow(self.COLUMNS)

    def add(self, dataset: str, workload: str, operation: str, transactions: int, duration: float, step: int | None = None, details: str = "") -> dict:
        row = {
            "run_id": self.run_id, "timestamp_utc": datetime.now(UTC).isoformat(timespec="seconds"), "dataset": dataset, "workload": workload, "backend": "spark", "operation": operation,
            "step": "" if step is None else step, "transactions": transactions, "duration_sec": f"{duration:g}", "txns_per_sec": f"{transactions / duration if duration > 0 else 0.0:.9g}", "details": details,
        }
        with open(self.path, "a", newline="") as f:
            csv.DictWriter(f, self.COLUMNS).writerow(row)
        return row


def rate_ratio(results: DataFrame, ours: Sequence[str], baseline: str, workloads: Sequence[str] = ("w2", "w4", "w5", "w6", "w8")) -> DataFrame:
    """(our_tpm, baseline_tpm, ratio): means over samples, then over ``ours``, then over cases, in transactions a minute."""
    rate = finite(F.col("txns_per_sec").cast("double"))
    usable = results.where(F.lower("workload").isin(*workloads)).select("workload", "operation", "step", "backend", rate.alias("tps")).where("tps IS NOT NULL")
    means = usable.groupBy("workload", "operation", "step", "backend").agg(F.avg("tps").alias("tps"))
    of = lambda names: F.avg(F.when(F.col("backend").isin(*names), F.col("tps")))
    held = F.countDistinct(F.when(F.col("backend").isin(*ours, baseline), F.col("backend")))
    cases = means.groupBy("workload", "operation", "step").agg(of(list(ours)).alias("a"), of([baseline]).alias("b"), held.alias("n")).where(F.col("n") == len(ours) + 1)
    return cases.agg((F.avg("a") * 60).alias("our_tpm"), (F.avg("b") * 60).alias("baseline_tpm"), F.try_divide(F.avg("a"), F.avg("b")).alias("ratio"))


def vtu_text(mesh: Mesh, step: int, variables: Sequence[str]) -> str:
    """A zone's frame as an ASCII VTK XML grid; an export of what fits one file, so rows come to the driver."""
    nodes = mesh.nodes.orderBy("node_id").collect()
    index = {r["node_id"]: k for k, r in enumerate(nodes)}
    kinds = mesh.cell_nodes.select("cell_id", "node_ids", vtk_cell_type(F.lit(None).cast("string"), F.size("node_ids")).alias("kind")).orderBy("cell_id").collect()
    values = {(r["var"], r["cell_id"]): r["value"] for r in mesh.cell_scalar.where((F.col("step") == step) & F.col("var").isin(*variables)).collect()}
    out = io.StringIO()
    array = lambda name, kind, items, n=1: out.write(f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="ascii">{" ".join(items)}</DataArray>\n')
    out.write(f'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="0.1"><UnstructuredGrid><Piece NumberOfPoints="{len(nodes)}" NumberOfCells="{len(kinds)}">\n<Points>\n')
    array("Points", "Float64", [repr(r[a]) for r in nodes for a in "xyz"], 3)
    out.write("</Points>\n<Cells>\n")
    array("connectivity", "Int64", [str(index[n]) for r in kinds for n in r["node_ids"]])
    ends, total = [], 0
    for r in kinds:
        total += len(r["node_ids"])
        ends.append(str(total))
    array("offsets", "Int64", ends)
    array("types", "UInt8", [str(r["kind"]) for r in kinds])
    out.write("</Cells>\n<CellData>\n")
    for v in variables:
        array(v, "Float64", [repr(x) if (x := values.get((v, r["cell_id"]))) is not None else "nan" for r in kinds])
    out.write("</CellData>\n</Piece></UnstructuredGrid></VTKFile>\n")
    return out.getvalue()


def read_vtu(spark, text: str) -> Mesh:  # noqa: ANN001
    """An ASCII VTK XML grid as a mesh with one frame, step 0."""
    import xml.etree.ElementTree as ET

    import pandas as pd

    from spindrift.operators.topology import cells_from_nodes
    from spindrift.sources.model import SCHEMAS

    piece = ET.fromstring(text).find(".//Piece")
    if piece is None:
        raise ValueError("the grid has no piece")
    read = lambda where, name: (piece.find(f"./{where}/DataArray[@Name='{name}']").text or "").split()  # type: ignore[union-attr]
    xyz = [float(v) for v in read("Points", "Points")]
    ends = [0, *map(int, read("Cells", "offsets"))]
    flat = [int(v) for v in read("Cells", "connectivity")]
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": range(len(xyz) // 3)} | {a: xyz[i::3] for i, a in enumerate("xyz")}), SCHEMAS["nodes"])
    cell_nodes = spark.createDataFrame([(k, flat[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))], SCHEMAS["cell_nodes"])
    rows = [(0, d.get("Name"), k, float(v)) for d in piece.findall("./CellData/DataArray") for k, v in enumerate((d.text or "").split())]
    return Mesh.of(spark, nodes=nodes, cell_nodes=cell_nodes, cells=cells_from_nodes(cell_nodes, nodes), cell_scalar=spark.createDataFrame(rows, SCHEMAS["cell_scalar"]))
