"""Command line: ingest, inspect-h5, ingest-h5, run, interpolate, couple, bounds, serve."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.operators import fields, interpolate
from spindrift.operators.align import align_tables, alignment_zone
from spindrift.plans import workloads
from spindrift.plans.session import MeshSession
from spindrift.sources import odbh5, sinks, tecplot
from spindrift.sources.derived import store_max_diffs
from spindrift.sources.model import discover, preferred_zone, read_mesh, read_table, write_mesh


def spark_session(name: str = "spindrift") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.sources.partitionOverwriteMode", "dynamic").getOrCreate()


def parse_mapping(items: Sequence[str]) -> dict[str, tuple[str, str | None]]:
    """Entries TARGET=FIELD or TARGET=FIELD.COMPONENT."""
    out: dict[str, tuple[str, str | None]] = {}
    for item in items:
        target, eq, source = item.partition("=")
        if not eq or not target or not source:
            raise ValueError(f"{item!r} is not TARGET=FIELD[.COMPONENT]")
        name, _, part = source.partition(".")
        out[target.strip().upper()] = (name.strip(), part.strip() or None)
    return out


def stored_session(spark: SparkSession, store: str, dataset: str, zone: str | None, step: int | None) -> MeshSession:
    """A session on a stored zone, by default the preferred one and its first frame."""
    found = discover(read_table(spark, store, "cell_scalar").where(F.col("dataset") == dataset)).collect()
    if not found:
        raise ValueError(f"dataset {dataset!r} is not stored in {store}")
    zone = zone or preferred_zone([r["zone"] for r in found])
    row = next((r for r in found if r["zone"] == zone), None)
    if row is None:
        raise ValueError(f"zone {zone!r} is not stored")
    if step is not None and step not in row["steps"]:
        raise ValueError(f"step {step} is not stored; steps: {row['steps']}")
    return MeshSession(read_mesh(spark, store, dataset, zone), row["steps"][0] if step is None else step, dataset, zone, store)


def bounds_payload(session: MeshSession, points: Sequence[Sequence[float]] = ()) -> dict:
    """Bounds, extent, tolerance and where each point lies."""
    from spindrift.functions.geometry import box_tolerance, outside_axes

    b = session.get_mesh_bounds()
    low, high = b[::2], b[1::2]
    payload: dict = {
        "dataset": session.dataset, "zone": session.zone, "bounds": dict(zip(("xmin", "xmax", "ymin", "ymax", "zmin", "zmax"), b, strict=True)),
        "extent": {a: q - p for a, p, q in zip("xyz", low, high, strict=True)}, "tolerance": box_tolerance(low, high), "points": [],
    }
    if points:
        sides, gap = outside_axes([F.col(a) for a in "xyz"], low, high)
        rows = session.points(points).select("point_id", "x", "y", "z", sides.alias("s"), gap.alias("d")).orderBy("point_id").collect()
        payload["points"] = [{"point": [r["x"], r["y"], r["z"]], "inside_aabb": not r["s"], "outside_axes": r["s"], "distance_to_aabb": r["d"]} for r in rows]
    return payload


def _print_bounds(payload: dict) -> None:
    print(f"mesh bounds of {payload['dataset']} / {payload['zone']}")
    for a in "xyz":
        print(f"  {a}: [{payload['bounds'][a + 'min']:.12g}, {payload['bounds'][a + 'max']:.12g}] extent={payload['extent'][a]:.12g}")
    print(f"  tolerance={payload['tolerance']:.6e}")
    for k, p in enumerate(payload["points"], 1):
        where = "INSIDE_AABB" if p["inside_aabb"] else f"OUTSIDE_AABB axes={','.join(p['outside_axes'])} distance={p['distance_to_aabb']:.12g}"
        print(f"  point[{k}] {where}")


def _ingest(a: argparse.Namespace, spark: SparkSession) -> int:
    zones = [r["zone"] for r in tecplot.read_part(spark, a.path, "zones").select("zone").distinct().orderBy("zone").collect()]
    for zone in [z for z in zones if not a.zone or z in a.zone]:
        write_mesh(tecplot.read_tecplot(spark, a.path, zone), a.store, a.dataset, zone)
        store_max_diffs(read_mesh(spark, a.store, a.dataset, zone), a.store, a.dataset, zone)
        print(f"stored {a.dataset}/{zone}")
    return 0


def _inspect_h5(a: argparse.Namespace, spark: SparkSession) -> int:
    found = odbh5.OdbReader(odbh5.open_tree(a.path)).inspect()
    found["frames"] = [{**asdict(f), "fields": {n: asdict(i) for n, i in fields_.items()}} for f, fields_ in found["frames"]]
    print(json.dumps(found, indent=2))
    return 0


def _ingest_h5(a: argparse.Namespace, spark: SparkSession) -> int:
    tree = odbh5.open_tree(a.path)
    options = {"instance": a.instance, "timestep": a.timestep, "explicit": parse_mapping(a.map)}
    plan = odbh5.OdbReader(tree).plan(**options)
    print(json.dumps({"instance": plan.instance, "frames": [[s, f.path, m] for s, f, m in plan.frames], "skipped": plan.skipped}))
    if not a.dry_run:
        write_mesh(odbh5.read_odb(spark, tree, **options)[0], a.store, a.dataset, a.zone)
        store_max_diffs(read_mesh(spark, a.store, a.dataset, a.zone), a.store, a.dataset, a.zone)
    return 0


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    log = sinks.ResultLog(a.output) if a.output else None
    for dataset in a.dataset:
        session = stored_session(spark, a.store, dataset, a.zone, a.step)
        for row in workloads.run(session, a.workloads or workloads.DEFAULT, a.duration, a.seed, a.variable, log=log):
            print(json.dumps(row))
    return 0


def _interpolate(a: argparse.Namespace, spark: SparkSession) -> int:
    session = stored_session(spark, a.store, a.dataset, a.zone, a.step)
    for point in a.point:
        print(json.dumps({"point": point, **session.interpolate(point, a.variable or None)}))
    return 0


def _couple(a: argparse.Namespace, spark: SparkSession) -> int:
    fluid = stored_session(spark, a.store, a.fluid, a.zone, a.step)
    structure = stored_session(spark, a.store, a.structure, a.structure_zone, None)
    points = structure.mesh.nodes.select(F.col("node_id").alias("point_id"), "x", "y", "z")
    notes = {"fluid": a.fluid, "structure": a.structure, "step": str(fluid.step)}
    if a.align:
        stored = [r["zone"] for r in read_table(spark, a.store, "cells").where(F.col("dataset") == a.fluid).select("zone").distinct().collect()]
        reference = read_mesh(spark, a.store, a.fluid, alignment_zone(stored, a.alignment_zone)).nodes
        fit = align_tables(points, reference, a.max_points)
        notes |= {"confidence": fit.confidence, "scale": repr(fit.transform.scale), "rmse": repr(fit.rmse_after)}
        points = fit.transform.transform(points)
    coupled = fluid.couple(points, a.variable or None)
    sinks.write_coupling(coupled, a.output, notes)
    for r in interpolate.status_counts(spark.read.parquet(f"{a.output}/points")).collect():
        print(f"{r['status']} {r['n']}")
    return 0


def _bounds(a: argparse.Namespace, spark: SparkSession) -> int:
    payload = bounds_payload(stored_session(spark, a.store, a.dataset, a.zone, None), a.point)
    print(json.dumps(payload, separators=(",", ":"))) if a.json else _print_bounds(payload)
    return 0


def _datasets(a: argparse.Namespace, spark: SparkSession) -> int:
    for r in discover(read_table(spark, a.store, "cell_scalar")).orderBy("dataset", "zone").collect():
        print(json.dumps(r.asDict()))
    return 0


def _statistics(a: argparse.Namespace, spark: SparkSession) -> int:
    session = stored_session(spark, a.store, a.dataset, a.zone, a.step)
    for r in fields.frame_statistics(session.mesh.cell_scalar, session.mesh.node_scalar, step=a.step).orderBy("step", "var").collect():
        print(json.dumps(r.asDict()))
    return 0


def _serve(a: argparse.Namespace, spark: SparkSession) -> int:
    from spindrift.service import serve

    serve(a.store, a.work, a.host, a.port)
    return 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="spindrift")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, act, **arguments: dict) -> None:  # noqa: ANN001
        p = commands.add_parser(name)
        p.set_defaults(act=act)
        for key, options in arguments.items():
            p.add_argument(f"--{key.replace('_', '-')}", **options)

    need, text, point = {"required": True}, {"default": None}, {"nargs": 3, "type": float, "action": "append", "default": []}
    whole = {"type": int, "default": None}
    many = {"nargs": "*", "default": []}
    add("ingest", _ingest, path=need, store=need, dataset=need, zone=many)
    add("inspect-h5", _inspect_h5, path=need)
    add("ingest-h5", _ingest_h5, path=need, store=need, dataset=need, zone={"default": "0_Structure"}, instance=text, timestep={"default": "sequence"}, map={"nargs": "*", "default": []}, dry_run={"action": "store_true"})
    add("run", _run, store=need, dataset={"nargs": "+", "required": True}, zone=text, step=whole, workloads={"nargs": "*", "choices": workloads.ALL, "default": []}, duration={"type": float, "default": 60.0}, seed={"type": int, "default": 0}, variable={"default": "P"}, output=text)
    add("interpolate", _interpolate, store=need, dataset=need, zone=text, step=whole, point=point, variable=many)
    add("couple", _couple, store=need, fluid=need, structure=need, zone=text, structure_zone=text, step=whole, variable=many, output=need, align={"action": "store_true"}, alignment_zone=text, max_points={"type": int, "default": 10_000})
    add("bounds", _bounds, store=need, dataset=need, zone=text, point=point, json={"action": "store_true"})
    add("datasets", _datasets, store=need)
    add("statistics", _statistics, store=need, dataset=need, zone=text, step=whole)
    add("serve", _serve, store=need, work=need, host={"default": "127.0.0.1"}, port={"type": int, "default": 8080})
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    return args.act(args, spark_session())


if __name__ == "__main__":
    sys.exit(main())
