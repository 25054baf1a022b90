"""Finite-element results in ODB-like HDF5 trees, planned on the driver and read as DataFrames.

A tree is anything that maps names to groups and datasets with ``attrs``: an open
HDF5 file, or nested ``Group`` objects where the HDF5 library is not installed.
Planning looks at names and attributes only; arrays of a frame are read one field
at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.topology import adjacency_by_nodes, cells_from_nodes, component, integration_to_cell, nodal_to_cell
from spindrift.sources.model import SCHEMAS, Mesh

VECTOR = ("U", "V", "W")
SCALARS = ("P", "K", "E")


class Group(dict):
    """In-memory tree node; paths with slashes reach into it."""

    def __init__(self, children: Mapping | None = None, **attrs: Any) -> None:
        super().__init__(children or {})
        self.attrs = {k.replace("__", "/"): v for k, v in attrs.items()}

    def __getitem__(self, path: str) -> Any:
        head, _, rest = path.partition("/")
        found = super().__getitem__(head)
        return found[rest] if rest else found

    def get(self, path: str, default: Any = None) -> Any:
        try:
            return self[path]
        except KeyError:
            return default

    def __contains__(self, path: object) -> bool:
        return self.get(str(path)) is not None


def open_tree(path: str) -> Any:
    """The file's root; needs the optional HDF5 library."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the optional package h5py") from e
    return h5py.File(path, "r")


def _text(value: Any) -> str:
    value = value.item() if isinstance(value, np.generic) or isinstance(value, np.ndarray) and value.size == 1 else value
    return value.decode() if isinstance(value, bytes) else str(value)


def _labels(value: Any) -> tuple[str, ...]:
    return () if value is None else tuple(_text(v) for v in np.asarray(value).ravel())


def _number(value: Any, kind: type = int) -> Any:
    return None if value is None else kind(np.asarray(value).ravel()[0])


def _suffix(name: str, prefix: str) -> int:
    m = re.fullmatch(re.escape(prefix) + r"(\d+)", name)
    return int(m[1]) if m else 10**9


@dataclass(frozen=True)
class Frame:
    step_name: str
    step_index: int
    step_domain: int | None
    frame_name: str
    frame_index: int
    inc_or_mode: int | None
    time_or_frequency: float | None
    description: str
    load_case: str

    @property
    def path(self) -> str:
        return f"Steps/{self.step_name}/Frames/{self.frame_name}"


@dataclass(frozen=True)
class FieldInfo:
    components: tuple[str, ...]
    instances: tuple[str, ...]


@dataclass(frozen=True)
class Block:
    name: str
    element_type: str
    first: int
    labels: np.ndarray
    nodes: np.ndarray


@dataclass(frozen=True)
class Plan:
    """What is read: the instance, its blocks, and each frame's step with its mapping target -> (field, component)."""

    instance: str
    part: str
    frames: tuple[tuple[int, Frame, dict[str, tuple[str, str | None]]], ...]
    skipped: tuple[str, ...]


class OdbReader:
    def __init__(self, tree: Any) -> None:
        self.tree = tree

    def parts(self) -> list[str]:
        return sorted(self.tree.get("Parts") or ())

    def instances(self) -> dict[str, str]:
        found = self.tree.get("Assembly/Instances") or {}
        return {n: _text(found[n].attrs.get("PartName", "")) for n in sorted(found)}

    def frames(self, steps: list[str] | None = None) -> Iterator[Frame]:
        """Frames by step index, then frame number."""
        tree = self.tree.get("Steps") or {}
        order = sorted(tree, key=lambda n: (_number(tree[n].attrs.get("Index")) or 10**9, n))
        for k, name in enumerate(order):
            if steps is not None and name not in steps:
                continue
            step, inner = tree[name], tree[name].get("Frames") or {}
            for j, frame_name in enumerate(sorted(inner, key=lambda n: (_suffix(n, "Frame:"), n))):
                at = inner[frame_name].attrs
                n = _suffix(frame_name, "Frame:")
                yield Frame(
                    name, _number(step.attrs.get("Index")) or k + 1, _number(step.attrs.get("Domain")), frame_name, j if n == 10**9 else n, _number(at.get("Inc/Mode")),
                    _number(at.get("Time/Freq"), float), _text(at.get("Description", "")), _text(at.get("LoadCase", "")),
                )

    def fields(self, frame: Frame) -> dict[str, FieldInfo]:
        group = self.tree[frame.path]
        return {n: FieldInfo(_labels(group[n].attrs.get("ComponentLabels")), tuple(sorted(group[n]))) for n in group}

    def resolve(self, instance: str | None = None) -> tuple[str, str]:
        """(instance, part): the one named, the only one, or the only one with most results."""
        known = self.instances()
        if instance is None:
            if len(known) == 1:
                instance = next(iter(known))
            else:
                held = {n: sum(n in f.instances for frame in self.frames() for f in self.fields(frame).values()) for n in known}
                most = max(held.values(), default=0)
                best = [n for n, c in held.items() if c == most and c]
                if len(best) != 1:
                    raise ValueError(f"the instance must be named: {held}")
                instance = best[0]
        if not known.get(instance):
            raise ValueError(f"instance {instance!r} is unknown or has no part; known: {sorted(known)}")
        return instance, known[instance]

    def blocks(self, part: str) -> list[Block]:
        """Element blocks by class number; connectivities are row numbers of the part's nodes."""
        root, out, first = self.tree[f"Parts/{part}/Elements"], [], 0
        for name in sorted(root, key=lambda n: (_suffix(n, "ElementClass:"), n)):
            group = root[name]
            if "Labels" not in group or "Connectivities" not in group:
                continue
            labels = np.asarray(group["Labels"][...], np.int64).ravel()
            nodes = np.asarray(group["Connectivities"][...], np.int64)
            nodes = nodes.reshape(len(labels), -1)
            out.append(Block(name, _text(group.attrs.get("ElementType", "")), first, labels, nodes))
            first += len(labels)
        return out

    def choose_vector(self, infos: dict[str, FieldInfo], instance: str, preferred: str | None = None) -> str | None:
        """A field of three or more components: the preferred, a common name, or one whose components are named U1.. or V1.."""
        valid = {n: f for n, f in infos.items() if instance in f.instances and len(f.components) >= 3}
        upper = {n.upper(): n for n in valid}
        for name in (*((preferred.upper(),) if preferred else ()), "U", "V", "VELOCITY", "DISPLACEMENT"):
            if name in upper:
                return upper[name]
        for name in sorted(valid):
            held = {c.upper() for c in valid[name].components}
            if any({f"{v}{i}" for i in (1, 2, 3)} <= held for v in "UV"):
                return name
        return None

    def mapping(self, frame: Frame, instance: str, vector: str | None = None, scalars: tuple[str, ...] = SCALARS, explicit: dict[str, tuple[str, str | None]] | None = None) -> dict[str, tuple[str, str | None]]:
        """U, V, W from a vector field, scalars of the same name, then explicit entries over both."""
        infos = self.fields(frame)
        found: dict[str, tuple[str, str | None]] = {}
        chosen = self.choose_vector(infos, instance, vector)
        if chosen:
            named = {c.upper(): c for c in infos[chosen].components}
            ways = [[named.get(f"{chosen.upper()}{i}") for i in (1, 2, 3)], [named.get(a) for a in "XYZ"], list(infos[chosen].components[:3])]
            found |= {t: (chosen, c) for t, c in zip(VECTOR, next(w for w in ways if all(w)), strict=True)}
        by_name = {n.upper(): n for n in infos}
        wanted = {s.upper(): (s, None) for s in scalars} | {t.upper(): src for t, src in (explicit or {}).items()}
        for target, (source, part) in wanted.items():
            name = by_name.get(source.upper())
            if name and instance in infos[name].instances:
                found[target] = (name, part)
        return found

    def plan(self, instance: str | None = None, timestep: str = "sequence", keep_empty: bool = False, **options: Any) -> Plan:
        """Frames with mapped data and their steps: a running number, the frame's number, or its increment or mode."""
        instance, part = self.resolve(instance)
        frames, skipped = [], []
        for frame in self.frames():
            found = self.mapping(frame, instance, **options)
            if not found and not keep_empty:
                skipped.append(f"{frame.step_name}/{frame.frame_name}")
                continue
            if timestep not in ("sequence", "frame-index", "inc-mode"):
                raise ValueError(f"unknown timestep {timestep!r}")
            step = {"sequence": len(frames), "frame-index": frame.frame_index, "inc-mode": frame.inc_or_mode}[timestep]
            if step is None:
                raise ValueError(f"{frame.path} has no Inc/Mode")
            frames.append((int(step), frame, found))
        return Plan(instance, part, tuple(frames), tuple(skipped))

    def inspect(self) -> dict[str, Any]:
        return {"parts": self.parts(), "instances": self.instances(), "frames": [(f, self.fields(f)) for f in self.frames()]}


def frame_metadata(spark: SparkSession, plan: Plan) -> DataFrame:
    rows = [(step, f.step_name, f.step_index, f.step_domain, f.frame_name, f.frame_index, f.inc_or_mode, f.time_or_frequency, f.description, f.load_case) for step, f, _ in plan.frames]
    return spark.createDataFrame(rows, "step int, step_name string, step_index int, step_domain int, frame_name string, frame_index int, inc_or_mode int, time_or_frequency double, description string, load_case string")


def read_odb(spark: SparkSession, tree: Any, **options: Any) -> tuple[Mesh, Plan, DataFrame]:
    """(mesh, plan, element types): topology, nodal scalars and cell scalars of the planned frames.

    Nodal fields give node scalars and, by averaging, cell scalars; fields at
    integration points give cell scalars, averaged over samples, then locations.
    """
    reader = OdbReader(tree)
    plan = reader.plan(**options)
    part = tree[f"Parts/{plan.part}"]
    labels = np.asarray(part["Nodes"]["Labels"][...], np.int64).ravel()
    xyz = np.asarray(part["Nodes"]["Coordinates"][...], float)
    xyz = np.pad(xyz[:, :3], ((0, 0), (0, max(0, 3 - xyz.shape[1]))))
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": np.arange(len(labels))} | {a: xyz[:, i] for i, a in enumerate("xyz")}), SCHEMAS["nodes"])
    node_source = spark.createDataFrame(pd.DataFrame({"node_id": np.arange(len(labels)), "source_label": labels}), SCHEMAS["node_source"])
    blocks = reader.blocks(plan.part)
    rows = [(b.first + k, int(label), n.tolist(), b.element_type) for b in blocks for k, (label, n) in enumerate(zip(b.labels, b.nodes, strict=True))]
    elements = spark.createDataFrame(rows, "cell_id long, source_label long, node_ids array<long>, element_type string")
    cell_nodes = elements.select("cell_id", "node_ids")
    node_scalar, cell_scalar = [], []
    for step, frame, found in plan.frames:
        for target, (name, wanted) in found.items():
            group = tree[f"{frame.path}/{name}"]
            names = [c.upper() for c in _labels(group.attrs.get("ComponentLabels"))]
            key = [wanted.upper()] if wanted else []
            at = names.index(key[0]) if key else None
            held = group[plan.instance]
            if "Real" in held:
                values = _matrix(held["Real"])
                if len(values) != len(labels):
                    raise ValueError(f"{frame.path}/{name}: {len(values)} rows for {len(labels)} nodes")
                column = _reduced(spark, values, at).select(F.lit(step).alias("step"), F.lit(target).alias("var"), F.col("row").alias("node_id"), "value")
                node_scalar.append(column)
                cell_scalar.append(nodal_to_cell(cell_nodes, column).select("step", "var", "cell_id", "value"))
            else:
                cell_scalar.append(_at_cells(spark, held, blocks, at).select(F.lit(step).alias("step"), F.lit(target).alias("var"), "cell_id", "value"))
    edges = adjacency_by_nodes(elements.select("cell_id", "node_ids", "element_type"))
    tables = {"nodes": nodes, "node_source": node_source, "cell_nodes": cell_nodes, "edges": edges, "cells": cells_from_nodes(cell_nodes, nodes), "cell_source": elements.select("cell_id", "source_label")}
    for name, parts in (("node_scalar", node_scalar), ("cell_scalar", cell_scalar)):
        if parts:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            tables[name] = whole
    return Mesh.of(spark, {"instance": plan.instance}, **tables), plan, elements.select("cell_id", "element_type")


def _matrix(dataset: Any) -> np.ndarray:
    values = np.asarray(dataset[...], float)
    return values.reshape(len(values), -1)


def _reduced(spark: SparkSession, values: np.ndarray, at: int | None) -> DataFrame:
    """(row, value): one component, the only one, or the norm of several."""
    index = at if at is not None else 0 if values.shape[1] == 1 else None
    flat = pa.array(np.ascontiguousarray(values).ravel())
    table = pa.table({"row": pa.array(np.arange(len(values))), "values": pa.FixedSizeListArray.from_arrays(flat, values.shape[1]).cast(pa.list_(pa.float64()))})
    frame = spark.createDataFrame(table)
    return frame.select("row", component(F.col("values"), index).alias("value"))


def _at_cells(spark: SparkSession, held: Any, blocks: list[Block], at: int | None) -> DataFrame:
    samples, sizes = None, []
    for b in blocks:
        if b.name not in held:
            continue
        group = held[b.name]
        locations = [n for n in sorted(group, key=lambda n: (_suffix(n, "LocationIndex:"), n)) if "Real" in group[n]]
        for k, name in enumerate(locations):
            values = _matrix(group[name]["Real"])
            if len(values) % len(b.labels):
                raise ValueError(f"{b.name}/{name}: {len(values)} rows for {len(b.labels)} elements")
            part = _reduced(spark, values, at).select(F.lit(f"{b.name}/{k}").alias("block"), F.lit(k).alias("location"), "row", "value")
            samples = part if samples is None else samples.unionByName(part)
            sizes.append((f"{b.name}/{k}", b.first, len(b.labels), len(values)))
    if samples is None:
        return spark.createDataFrame([], "cell_id long, value double")
    shape = spark.createDataFrame(sizes, "block string, first long, n_elements long, n_rows long")
    means = integration_to_cell(samples, shape.drop("first")).join(shape.select("block", "first"), "block")
    return means.groupBy((F.col("first") + F.col("element")).alias("cell_id")).agg(F.avg("value").alias("value"))
