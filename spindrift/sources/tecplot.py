"""Tecplot ASCII zones (FEPolyhedron, FEPolygon; BLOCK packing) as a Spark data source.

``spark.read.format("tecplot").option("part", ...).load(path)`` reads a file or a
folder: ``nodes``, ``faces`` and ``scalars`` are tables over all zones and frames,
``zones`` their headers.  Files are partitions; topology comes from the frame of
the smallest step.  Paths go through pyarrow's file systems where they name one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spindrift.operators.topology import mesh_from_faces
from spindrift.sources.model import Mesh, zone_token

_COUNTS = {"nodes": ("Nodes", "N"), "elements": ("Elements", "E"), "faces": ("Faces", "F")}
_SECTION = re.compile(r"^[ \t]*#[ \t]*(.+?)[ \t]*$", re.M)
_SECTIONS = {
    "counts": ("node count per face", "node counts per face"),
    "nodes": ("face nodes", "face node"),
    "left": ("left elements", "left element"),
    "right": ("right elements", "right element"),
}
SCHEMAS = {
    "zones": "file string, step int, zone string, zone_type string, n_nodes long, n_elements long, n_faces long, variables array<string>",
    "nodes": "step int, zone string, node_id long, x double, y double, z double",
    "faces": "step int, zone string, face_id long, node_ids array<long>, left long, right long",
    "scalars": "step int, zone string, var string, cell_id long, value double",
}


@dataclass
class Zone:
    name: str
    kind: str
    n_nodes: int
    n_elements: int
    n_faces: int
    nodes: np.ndarray
    fields: dict[str, np.ndarray]
    face_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    face_nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def step_of(path: str) -> int:
    """Leading digits of the file's name."""
    m = re.match(r"(\d+)", path.rstrip("/").rpartition("/")[2])
    if not m:
        raise ValueError(f"{path}: the name of a frame starts with its step")
    return int(m[1])


def _count(header: str, name: str) -> int:
    for key in _COUNTS[name]:
        m = re.search(rf"(?<![A-Za-z]){key}\s*=\s*(\d+)", header, re.I)
        if m:
            return int(m[1])
    raise ValueError(f"a zone header gives no {name} count")


def _numbers(text: str, kind: type) -> np.ndarray:
    return np.array(text.split(), dtype=kind)


def _topology(zone: Zone, body: str) -> None:
    marks = list(_SECTION.finditer(body))
    texts = {re.sub(r"\s+", " ", m[1].lower()): body[m.end() : (marks[k + 1].start() if k + 1 < len(marks) else len(body))] for k, m in enumerate(marks)}
    found = {part: next((_numbers(texts[n], np.int64) for n in names if n in texts), None) for part, names in _SECTIONS.items()}
    if zone.n_faces and any(found[p] is None for p in ("nodes", "left", "right")):
        raise ValueError(f"zone {zone.name}: face nodes, left and right elements are needed")
    counts = found["counts"] if found["counts"] is not None else np.full(zone.n_faces, 2, np.int64)
    nodes, left, right = (np.zeros(0, np.int64) if found[p] is None else found[p] - 1 for p in ("nodes", "left", "right"))
    for what, values, expected in (("node counts", counts, zone.n_faces), ("face nodes", nodes, int(counts.sum())), ("left elements", left, zone.n_faces), ("right elements", right, zone.n_faces)):
        if len(values) != expected:
            raise ValueError(f"zone {zone.name}: {len(values)} {what}, expected {expected}")
    for what, values, low, high in (("node", nodes, 0, zone.n_nodes), ("left element", left, -1, zone.n_elements), ("right element", right, -1, zone.n_elements)):
        if len(values) and (values.min() < low or values.max() >= high):
            raise ValueError(f"zone {zone.name}: a {what} id is out of range")
    zone.face_counts, zone.face_nodes, zone.left, zone.right = counts, nodes, left, right


def parse(text: str, topology: bool = True) -> list[Zone]:
    """Zones of a file in order.  The first three variables are nodal, the others of cells; element 0 is outside (-1)."""
    head, *blocks = re.split(r"^[ \t]*ZONE\s+T\s*=", text, flags=re.M | re.I)
    named = re.search(r"VARIABLES\s*=\s*((?:\"[^\"]*\"[\s,]*)+)", head, re.I)
    variables = re.findall(r'"([^"]*)"', named[1]) if named else ["X", "Y", "Z"]
    zones = []
    for block in blocks:
        cut = re.search(r"\bDT\s*=\s*\([^)]*\)", block, re.I)
        if not cut:
            raise ValueError("a zone has no DT=(...) declaration")
        header, body = block[: cut.start()], block[cut.end() :]
        name = re.match(r'\s*"([^"]+)"', header)
        kind = re.search(r"\bZONETYPE\s*=\s*(\w+)", header, re.I)
        n_nodes, n_elements, n_faces = (_count(header, c) for c in _COUNTS)
        if n_nodes <= 0 or n_elements <= 0:
            raise ValueError("a zone needs nodes and elements")
        values = _numbers(body.partition("#")[0], float)
        need = 3 * n_nodes + (len(variables) - 3) * n_elements
        if len(values) < need:
            raise ValueError(f"zone {name[1] if name else len(zones)}: {len(values)} values, expected {need}")
        coordinates = values[: 3 * n_nodes].reshape(3, n_nodes).T
        cells = values[3 * n_nodes : need].reshape(-1, n_elements)
        zone = Zone(zone_token(name[1] if name else f"Zone_{len(zones)}"), kind[1] if kind else "FEPolyhedron", n_nodes, n_elements, n_faces, coordinates, {v.upper(): cells[k] for k, v in enumerate(variables[3:])})
        if topology:
            _topology(zone, body)
        zones.append(zone)
    return zones


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def frame_files(path: str) -> list[str]:
    """The .dat files of a folder in order of their steps, or the one file."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.lower().endswith(".dat")]
    if not found:
        raise FileNotFoundError(f"no .dat file in {path}")
    prefix = path.partition("://")[0] + "://" if "://" in path else ""
    return [prefix + p if prefix and not p.startswith(prefix) else p for p in sorted(found, key=step_of)]


class _Frame(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str) -> None:
        self.path, self.part = path, part

    def partitions(self) -> list[_Frame]:
        files = frame_files(self.path)
        return [_Frame(p) for p in (files[:1] if self.part in ("nodes", "faces") else files)]

    def read(self, partition: _Frame) -> Iterator[pa.RecordBatch]:
        path = partition.value
        fs, at = _open(path)
        with fs.open_input_stream(at) as f:
            text = f.read().decode("utf-8")
        step = step_of(path)
        for z in parse(text, topology=self.part == "faces"):
            yield from getattr(self, f"_{self.part}")(path, step, z)

    @staticmethod
    def _keys(n: int, step: int, z: Zone) -> dict[str, pa.Array]:
        return {"step": pa.array(np.full(n, step, np.int32)), "zone": pa.array([z.name] * n)}

    def _zones(self, path: str, step: int, z: Zone) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict(
            {"file": [path], "step": pa.array([step], pa.int32()), "zone": [z.name], "zone_type": [z.kind], "n_nodes": [z.n_nodes], "n_elements": [z.n_elements], "n_faces": [z.n_faces], "variables": pa.array([list(z.fields)], pa.list_(pa.string()))}
        )

    def _nodes(self, path: str, step: int, z: Zone) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict(self._keys(z.n_nodes, step, z) | {"node_id": np.arange(z.n_nodes)} | {a: np.ascontiguousarray(z.nodes[:, i]) for i, a in enumerate("xyz")})

    def _faces(self, path: str, step: int, z: Zone) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate(([0], np.cumsum(z.face_counts))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.face_nodes))
        yield pa.RecordBatch.from_pydict(self._keys(z.n_faces, step, z) | {"face_id": np.arange(z.n_faces), "node_ids": lists, "left": z.left, "right": z.right})

    def _scalars(self, path: str, step: int, z: Zone) -> Iterator[pa.RecordBatch]:
        for var, values in z.fields.items():
            n = len(values)
            yield pa.RecordBatch.from_pydict(self._keys(n, step, z) | {"var": [var] * n, "cell_id": np.arange(n), "value": np.ascontiguousarray(values)})


class TecplotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tecplot"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "scalars")]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options.get("part", "scalars"))


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    spark.dataSource.register(TecplotSource)
    return spark.read.format("tecplot").option("part", part).load(path)


def check_frames(spark: SparkSession, path: str) -> None:
    """Each zone must have as many cells in every frame."""
    odd = read_part(spark, path, "zones").groupBy("zone").agg(F.countDistinct("n_elements").alias("n")).where("n > 1").first()
    if odd is not None:
        raise ValueError(f"zone {odd['zone']}: the number of cells differs between frames")


def read_tecplot(spark: SparkSession, path: str, zone: str | None = None) -> Mesh:
    """A zone's topology and all frames of its scalars; the first zone if none is named."""
    check_frames(spark, path)
    if zone is None:
        zone = parse_first_zone(path)
    pick = F.col("zone") == zone_token(zone)
    nodes = read_part(spark, path, "nodes").where(pick).select("node_id", "x", "y", "z")
    faces = read_part(spark, path, "faces").where(pick).select("face_id", "node_ids", "left", "right")
    scalars = read_part(spark, path, "scalars").where(pick).select("step", "var", "cell_id", "value")
    return mesh_from_faces(spark, nodes, faces, scalars, {"zone": zone_token(zone)})


def parse_first_zone(path: str) -> str:
    fs, at = _open(frame_files(path)[0])
    with fs.open_input_stream(at) as f:
        m = re.search(r'^[ \t]*ZONE\s+T\s*=\s*"([^"]+)"', f.read().decode("utf-8"), re.M | re.I)
    return zone_token(m[1] if m else "Zone_0")
