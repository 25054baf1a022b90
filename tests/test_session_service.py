from __future__ import annotations

import json
import math
import sys
import threading
import time
import urllib.error
import urllib.request

import pytest

from spindrift import cli
from spindrift.plans import workloads
from spindrift.plans.session import MeshSession
from spindrift.plans.workload_queries import TWO_ZONES
from spindrift.service import Uploads, make_server
from spindrift.sources.lattice import lattice_mesh
from spindrift.sources.sinks import ResultLog


@pytest.fixture(scope="module")
def session(spark, sf_dir):
    return MeshSession(lattice_mesh(spark, sf_dir), 3, "lattice")


def test_client_methods(session):
    assert session.get_cell_count() == 200 and session.get_mesh_bounds() == [0, 20, 0, 10, 0, 1]
    values = session.point_query([5, 10**9, 5], "P")
    assert values[0] == values[2] and math.isnan(values[1])
    assert len(session.velocity_query([1, 2])) == 2
    n, total, low, high = session.aggregate_point_query([1, 2, 3], "U")
    assert n == 3 and low <= total / n <= high
    lo, hi = session.var_value_range("P")
    assert lo < hi and session.var_value_range("none") == (0, 1)
    assert session.range_query_var(lo, hi, "P").count() == session.point_query.__self__.contiguous_point_query(0, 10**9, "P").count()
    assert [r["cell_id"] for r in session.point_intersection([(0.5, 0.5, 0.5), (99, 9, 9), (3.5, 2.5, 0.5)]).collect()] == [0, 43]
    assert session.line_intersection((-1, 0.5, 0.5), (30, 0.5, 0.5)).count() == 20
    assert session.plane_intersection((3.5, 0, 0), (1, 0, 0)).count() == 10
    assert session.extract_submesh([0, 1])["nodes"].count() == 12
    assert session.is_h5_dataset() and session.cfd_variables() == ["E", "K", "P", "U", "V", "W"]
    assert session.resolve_w6_scalar(("Z", "P")) == "P" and session.resolve_w6_scalar(("Z",)) == "E"
    assert set(session.get_max_diffs()) == {"E", "K", "P", "U", "V", "W"}
    assert len(session.surface_force_query("P")) == 3
    assert set(session.cfd_point_frame_extrema([1, 2, 10**9], "P")) == {1, 2}
    assert session.cfd_point_ids().count() == session.mesh.nodes.count() == 462
    with pytest.raises(ValueError):
        session.cfd_frame_statistics("none").count()
    with pytest.raises(ValueError):
        MeshSession(session.mesh).point_query([1], "P")


def test_inputs_are_seeded():
    a, b = (workloads.Inputs([0, 1, 0, 2, 0, 3], seed=4) for _ in range(2))
    assert a.points() == b.points() and a.box() == b.box() and a.plane() == b.plane()
    low, high = a.box()
    assert all(p <= q for p, q in zip(low, high))


@pytest.mark.parametrize("name", ["w1", "w2", "w3", "w6", "w7", "w8", "w9", "w10", "w11"])
def test_workloads_run(session, name, tmp_path):
    log = ResultLog(str(tmp_path / "r.csv"))
    rows = workloads.run(session, [name], duration=0, seed=1, log=log)
    assert rows and all(r["transactions"] == 1 for r in rows)


def test_trace_workloads_run(session):
    assert workloads.run(session, ["w4"], duration=0, seed=1)[0]["operation"] == "advection"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    (root / "in").mkdir()
    (root / "in" / "200_c.dat").write_text(TWO_ZONES.format(u="1 2", p="7 8"))
    assert cli.main(["ingest", "--path", str(root / "in"), "--store", str(root / "s"), "--dataset", "tets"]) == 0
    return root


def test_command_line(store, capsys):
    s = ["--store", str(store / "s"), "--dataset", "tets"]
    assert cli.main(["bounds", *s, "--point", "0.2", "0.2", "0.2", "--point", "3", "0", "0", "--json"]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["bounds"]["zmin"] == -1 and [p["inside_aabb"] for p in got["points"]] == [True, False] and got["points"][1]["outside_axes"] == ["x+"]
    assert cli.main(["bounds", *s, "--point", "3", "0", "0"]) == 0
    assert "OUTSIDE_AABB axes=x+ distance=2" in capsys.readouterr().out
    assert cli.main(["interpolate", *s, "--point", "0.2", "0.2", "0.2", "--variable", "P"]) == 0
    assert 7 < json.loads(capsys.readouterr().out.strip().splitlines()[-1])["values"]["P"] < 8
    assert cli.main(["run", *s, "--workloads", "w10", "--duration", "0", "--output", str(store / "o.csv")]) == 0
    assert (store / "o.csv").read_text().count("\n") == 2
    assert cli.main(["couple", "--store", str(store / "s"), "--fluid", "tets", "--structure", "tets", "--output", str(store / "coupled"), "--variable", "P"]) == 0
    assert "PASS 5" in capsys.readouterr().out
    assert cli.main(["datasets", "--store", str(store / "s")]) == 0 and cli.main(["statistics", *s]) == 0
    with pytest.raises(ValueError):
        cli.main(["bounds", "--store", str(store / "s"), "--dataset", "none"])
    assert cli.parse_mapping(["T=S.S11", "p=P"]) == {"T": ("S", "S11"), "P": ("P", None)}
    with pytest.raises(ValueError):
        cli.parse_mapping(["T"])


def call(server, method, path, body=b""):
    raw = body if isinstance(body, bytes) else json.dumps(body).encode()
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", raw or None, method=method)
    try:
        with urllib.request.urlopen(request, timeout=20) as r:
            return r.status, json.loads(r.read() or b"null")
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service(tmp_path):
    child = tmp_path / "child.py"
    child.write_text("import sys, time\nprint('ran', sys.argv[1])\ntime.sleep(30 if 'slow' in sys.argv else 0)\n")
    server = make_server(str(tmp_path / "s"), str(tmp_path / "w"), "127.0.0.1", 0, read=lambda name, body: [name], command=(sys.executable, str(child)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert call(server, "GET", "/health")[0] == 200 and call(server, "GET", "/datasets") == (200, ["datasets"])
        key = call(server, "POST", "/uploads", {"files": ["1_a.dat"]})[1]["id"]
        assert call(server, "PATCH", f"/uploads/{key}/1_a.dat?offset=0", b"abc")[1]["files"] == {"1_a.dat": 3}
        assert call(server, "PATCH", f"/uploads/{key}/1_a.dat?offset=0", b"abc")[0] == 409
        assert call(server, "POST", "/ingests", {"upload": key, "dataset": "d"})[0] == 409
        assert call(server, "POST", f"/uploads/{key}/complete")[1]["complete"]
        job = call(server, "POST", "/ingests", {"upload": key, "dataset": "d"})[1]
        assert job["arguments"][:2] == ["--store", str(tmp_path / "s")]
        for bad in ({"dataset": "--output"}, {"output": "x"}, {"dataset": "a b; c"}, {"upload": "../.."}):
            assert call(server, "POST", "/benchmarks", bad)[0] in (403, 404, 422)
        assert call(server, "POST", "/uploads", {"files": ["../x"]})[0] == 422
        wait(server, job["id"], "succeeded")
        assert "ran ingest" in call(server, "GET", f"/jobs/{job['id']}/logs")[1]["log"]
        slow = call(server, "POST", "/benchmarks", {"dataset": "slow"})[1]["id"]
        wait(server, slow, "running")
        assert call(server, "GET", "/datasets")[0] == 423 and call(server, "POST", "/interpolate", {})[0] == 423
        queued = call(server, "POST", "/couplings", {"fluid": "f"})[1]["id"]
        assert call(server, "POST", f"/jobs/{queued}/cancel")[1]["status"] == "cancelled"
        call(server, "POST", f"/jobs/{slow}/cancel")
        wait(server, slow, "cancelled")
        assert call(server, "GET", f"/jobs/{slow}/result")[0] == 409 and len(call(server, "GET", "/jobs")[1]) == 3
        assert call(server, "GET", "/jobs/none")[0] == 404 and call(server, "GET", "/nothing")[0] == 404
        assert call(server, "DELETE", f"/uploads/{key}")[0] == 200
    finally:
        server.shutdown()
    assert Uploads(str(tmp_path / "w" / "uploads")).root


def wait(server, key, status):
    for _ in range(200):
        if call(server, "GET", f"/jobs/{key}")[1]["status"] == status:
            return
        time.sleep(0.05)
    raise AssertionError(f"{key} never was {status}")
