"""A small HTTP job service over the command line: uploads, one heavy job at a time, results.

State is files under the work folder.  Ingests, benchmarks and couplings are jobs
that run as child processes; reads are refused while a benchmark runs.
"""

from __future__ import annotations

import json
import os
import re
import signal
import subprocess
import sys
import threading
import uuid
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

CHUNK_LIMIT = 128 * 1024 * 1024
_TOKEN = re.compile(r"[A-Za-z0-9_.][A-Za-z0-9_.:=/+-]*")
KINDS = {"ingests": "ingest", "h5-ingests": "ingest-h5", "benchmarks": "run", "couplings": "couple"}


class Refused(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def safe(value: object) -> str:
    """A request's value as one argument; never an option of the command."""
    text = str(value)
    if not _TOKEN.fullmatch(text) and not re.fullmatch(r"-?[0-9.eE+-]+", text) or text.startswith("--"):
        raise Refused(422, f"{text!r} is not allowed")
    return text


def inside(root: str, path: str) -> str:
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise Refused(403, "the path leaves the allowed folder")
    return full


class Uploads:
    """Resumable files: chunks at their offsets, then one completion."""

    def __init__(self, root: str) -> None:
        self.root, self.lock = root, threading.Lock()

    def _file(self, key: str, name: str) -> str:
        if os.path.basename(name) != name or name in ("", ".", ".."):
            raise Refused(422, "a file name has no folders")
        return os.path.join(inside(self.root, safe(key)), name)

    def create(self, names: list[str]) -> dict:
        key = uuid.uuid4().hex
        os.makedirs(os.path.join(self.root, key))
        for name in names:
            open(self._file(key, name), "wb").close()
        return self.get(key)

    def get(self, key: str) -> dict:
        folder = inside(self.root, safe(key))
        if not os.path.isdir(folder):
            raise Refused(404, "no such upload")
        names = sorted(n for n in os.listdir(folder) if n != ".complete")
        return {"id": key, "complete": os.path.exists(os.path.join(folder, ".complete")), "files": {n: os.path.getsize(os.path.join(folder, n)) for n in names}}

    def append(self, key: str, name: str, offset: int, data: bytes) -> dict:
        if len(data) > CHUNK_LIMIT:
            raise Refused(413, "the chunk is too large")
        with self.lock:
            state = self.get(key)
            if state["complete"] or name not in state["files"]:
                raise Refused(409, "the upload takes no such file")
            if state["files"][name] != offset:
                raise Refused(409, f"the offset is {state['files'][name]}")
            with open(self._file(key, name), "ab") as f:
                f.write(data)
        return self.get(key)

    def complete(self, key: str) -> dict:
        self.get(key)
        open(os.path.join(self.root, key, ".complete"), "w").close()
        return self.get(key)

    def delete(self, key: str) -> dict:
        state = self.get(key)
        for name in (*state["files"], ".complete"):
            if os.path.exists(p := os.path.join(self.root, key, name)):
                os.remove(p)
        os.rmdir(os.path.join(self.root, key))
        return state


class Jobs:
    """A queue of child processes, one at a time; job files survive a restart."""

    def __init__(self, root: str, command: tuple[str, ...] = (sys.executable, "-m", "spindrift.cli")) -> None:
        self.root, self.command = root, command
        self.ready, self.running, self.process = threading.Condition(), None, None
        self.queue: list[str] = []
        for name in sorted(os.listdir(root)):
            job = self.get(name)
            if job["status"] in ("queued", "running"):
                self._put(job | {"status": "failed", "error": "the service stopped"})
        threading.Thread(target=self._loop, daemon=True).start()

    def _put(self, job: dict) -> dict:
        os.makedirs(os.path.join(self.root, job["id"]), exist_ok=True)
        path = os.path.join(self.root, job["id"], "job.json")
        with open(path + ".new", "w") as f:
            json.dump(job, f)
        os.replace(path + ".new", path)
        return job

    def get(self, key: str) -> dict:
        try:
            with open(os.path.join(inside(self.root, safe(key)), "job.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            raise Refused(404, "no such job") from None

    def list(self) -> list[dict]:
        return [self.get(n) for n in sorted(os.listdir(self.root))]

    def create(self, kind: str, arguments: list[str]) -> dict:
        job = {"id": uuid.uuid4().hex, "kind": kind, "arguments": arguments, "status": "queued", "created": datetime.now(UTC).isoformat()}
        with self.ready:
            self._put(job)
            self.queue.append(job["id"])
            self.ready.notify()
        return job

    def cancel(self, key: str) -> dict:
        with self.ready:
            job = self.get(key)
            if job["status"] == "queued":
                self.queue.remove(key)
                return self._put(job | {"status": "cancelled"})
            if job["status"] == "running" and self.process is not None:
                self._put(job | {"cancel": True})
                os.killpg(self.process.pid, signal.SIGTERM)
            return self.get(key)

    def benchmark_running(self) -> bool:
        return self.running is not None and self.get(self.running)["kind"] == "run"

    def log(self, key: str) -> str:
        self.get(key)
        try:
            with open(os.path.join(self.root, key, "log.txt")) as f:
                return f.read()
        except FileNotFoundError:
            return ""

    def _loop(self) -> None:
        while True:
            with self.ready:
                while not self.queue:
                    self.ready.wait()
                key = self.queue.pop(0)
                # reads close before anyone can see the job run
                self.running = key
                job = self._put(self.get(key) | {"status": "running"})
                log = open(os.path.join(self.root, key, "log.txt"), "w")  # noqa: SIM115
                self.process = subprocess.Popen([*self.command, job["kind"], *job["arguments"]], stdout=log, stderr=log, start_new_session=True)
            code = self.process.wait()
            log.close()
            with self.ready:
                job = self.get(key)
                self.running = self.process = None
                self._put(job | {"status": "cancelled" if job.get("cancel") else "succeeded" if code == 0 else "failed", "code": code})


def job_arguments(kind: str, body: dict, store: str, uploads: Uploads, result: str) -> list[str]:
    """Options of a request, each checked; paths are uploads or lie in the store."""
    out = ["--store", store]
    if "upload" in body:
        state = uploads.get(str(body.pop("upload")))
        if not state["complete"]:
            raise Refused(409, "the upload is not complete")
        folder = os.path.join(uploads.root, state["id"])
        out += ["--path", folder if kind == "ingest" else os.path.join(folder, next(iter(state["files"])))]
    for name, value in body.items():
        option = "--" + safe(name).replace("_", "-")
        if option in ("--store", "--path", "--output"):
            raise Refused(422, f"{option} is not a request's to set")
        if value is True:
            out.append(option)
        elif value not in (None, False):
            out += [option, *map(safe, value if isinstance(value, list) else [value])]
    return out + (["--output", result] if kind in ("run", "couple") else [])


def make_server(store: str, work: str, host: str, port: int, read=None, command: tuple[str, ...] | None = None) -> ThreadingHTTPServer:  # noqa: ANN001
    """The server; ``read(name, body)`` answers interactive reads (datasets, interpolate)."""
    for name in ("uploads", "jobs"):
        os.makedirs(os.path.join(work, name), exist_ok=True)
    uploads = Uploads(os.path.join(work, "uploads"))
    jobs = Jobs(os.path.join(work, "jobs"), *([command] if command else []))

    def answer(method: str, parts: list[str], query: dict[str, str], body: bytes) -> tuple[int, object]:
        data = lambda: json.loads(body or b"{}")
        match method, parts:
            case "GET", ["health"]:
                return 200, {"status": "ok"}
            case "GET", ["capabilities"]:
                return 200, {"jobs": sorted(KINDS), "chunk_limit": CHUNK_LIMIT}
            case ("GET", ["datasets"]) | ("POST", ["interpolate"]):
                if jobs.benchmark_running() or parts == ["interpolate"] and jobs.running:
                    raise Refused(423, "a heavy job runs")
                if read is None:
                    raise Refused(503, "no session")
                return 200, read(parts[0], data())
            case "POST", ["uploads"]:
                if jobs.benchmark_running():
                    raise Refused(423, "a benchmark runs")
                return 201, uploads.create([str(n) for n in data()["files"]])
            case ("GET" | "HEAD"), ["uploads", key]:
                return 200, uploads.get(key)
            case "PATCH", ["uploads", key, name]:
                return 200, uploads.append(key, name, int(query.get("offset", 0)), body)
            case "POST", ["uploads", key, "complete"]:
                return 200, uploads.complete(key)
            case "DELETE", ["uploads", key]:
                return 200, uploads.delete(key)
            case "POST", [kind] if kind in KINDS:
                result = os.path.join(work, "results", uuid.uuid4().hex)
                return 202, jobs.create(KINDS[kind], job_arguments(KINDS[kind], data(), store, uploads, result))
            case "GET", ["jobs"]:
                return 200, jobs.list()
            case "GET", ["jobs", key]:
                return 200, jobs.get(key)
            case "GET", ["jobs", key, "logs"]:
                return 200, {"log": jobs.log(key)}
            case "GET", ["jobs", key, "result"]:
                job = jobs.get(key)
                if job["status"] != "succeeded":
                    raise Refused(409, f"the job is {job['status']}")
                return 200, {"output": job["arguments"][-1] if "--output" in job["arguments"] else None, "log": jobs.log(key)}
            case "GET", ["jobs", key, "result.csv"]:
                job = jobs.get(key)
                if job["status"] != "succeeded" or job["kind"] != "run":
                    raise Refused(409, "the job has no result file")
                with open(job["arguments"][-1]) as f:
                    return 200, {"csv": f.read()}
            case "POST", ["uploads", key, "inspect-h5"]:
                state = uploads.get(key)
                if not state["complete"] or read is None:
                    raise Refused(409, "the upload is not complete" if read else "no session")
                return 200, read("inspect-h5", {"path": os.path.join(uploads.root, key, next(iter(state["files"])))})
            case "POST", ["jobs", key, "cancel"]:
                return 200, jobs.cancel(key)
        raise Refused(404, "no such resource")

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            path, _, query = self.path.partition("?")
            size = int(self.headers.get("Content-Length") or 0)
            try:
                if size > CHUNK_LIMIT:
                    raise Refused(413, "the body is too large")
                pairs = dict(p.partition("=")[::2] for p in query.split("&") if p)
                status, out = answer(self.command, [p for p in path.split("/") if p], pairs, self.rfile.read(size))
            except Refused as e:
                status, out = e.status, {"error": str(e)}
            except (ValueError, KeyError, TypeError) as e:
                status, out = 422, {"error": str(e)}
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(raw)

        do_GET = do_POST = do_PATCH = do_DELETE = do_HEAD = _do  # noqa: N815

        def log_message(self, *args) -> None:  # noqa: ANN002
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(store: str, work: str, host: str = "127.0.0.1", port: int = 8080) -> None:
    from spindrift.cli import spark_session, stored_session
    from spindrift.sources.model import discover, read_table

    spark = spark_session("spindrift-service")

    def read(name: str, body: dict) -> object:
        if name == "datasets":
            return [r.asDict() for r in discover(read_table(spark, store, "cell_scalar")).collect()]
        if name == "inspect-h5":
            from spindrift.sources.odbh5 import OdbReader, open_tree

            found = OdbReader(open_tree(body["path"])).inspect()
            return {"parts": found["parts"], "instances": found["instances"], "frames": [f.path for f, _ in found["frames"]]}
        session = stored_session(spark, store, body["dataset"], body.get("zone"), body.get("step"))
        return [session.interpolate(p, body.get("variables")) for p in body["points"]]

    make_server(store, work, host, port, read).serve_forever()
