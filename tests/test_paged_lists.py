"""Paged lists as a stream that is killed and goes on, filters that reach the server, and the gate in front of it."""

import json
import os
import subprocess
import sys
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from spendgrid.sources import http, paged
from spendgrid.streaming.cursors import Cursor

ITEMS = [("2020-01-01", "a", "a1", i, "open") for i in range(5)] + [("2020-01-03", "a", "a1", i, "open") for i in range(10, 21)] + [("2020-01-03", "b", "b1", i, "shut") for i in range(30, 34)] + [("2020-01-04", "b", "b1", 40, "shut")]


class _Lists(BaseHTTPRequestHandler):
    """At most 12 items a search; day 2 is empty, day 3 overflows."""

    asked: list = []

    def do_POST(self):  # noqa: N802
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append(ask)
        hit = [x for x in ITEMS if x[0] == ask["at"] and ask.get("cpvCategoryId", x[1]) == x[1] and ask.get("cpvCodeId", x[2]) == x[2] and ask.get("stateIs", x[4]) == x[4]]
        first = ask["pageIndex"] * ask["pageSize"]
        shown = [{"id": i, "at": d, "state": {"text": s}} for d, _, _, i, s in hit[:12][first : first + ask["pageSize"]]]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"total": len(hit), "items": shown, "searchTooLong": len(hit) > 12}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def api():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Lists)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def _options(url, **more):
    return {"url": url, "start": "2020-01-01", "end": "2020-01-05", "dateField": "at", "pageSize": "2", "categories": '{"a": ["a1"], "b": ["b1"]}', **more}


def _wanted():
    slice_of = lambda d, c: "day" if d != "2020-01-03" else c
    return sorted((d, slice_of(d, c), i) for d, c, _, i, _ in ITEMS)


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
from spendgrid.sources import paged
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
paged.register(spark)
folder, options = sys.argv[1], eval(sys.argv[2])
def write(batch, number):
    batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    if number == 2:
        os.kill(os.getpid(), signal.SIGKILL)
spark.readStream.format("paged_list").options(**options).load().writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").start().processAllAvailable()
"""


def test_a_stream_killed_between_read_and_commit_gives_each_row_once(spark, api, tmp_path):
    folder, options = str(tmp_path), _options(api, pagesPerTrigger="3", progress=str(tmp_path / "progress"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", KILLED, folder, repr(options)], env={**os.environ, "PYTHONPATH": root}, capture_output=True, timeout=300)
    assert done.returncode == -9, done.stderr[-2000:]
    assert sorted(os.listdir(f"{folder}/out"))[-1] == "batch=2" and not os.path.exists(f"{folder}/state/commits/2")
    paged.register(spark)
    seen = []

    def write(batch, number):
        seen.append((number, batch.select("day", "slice", "page").distinct().count()))
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = spark.readStream.format("paged_list").options(**options).load().writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen[0][0] == 2 and len(seen) >= 2 and all(n <= 3 for _, n in seen)
    rows = spark.read.parquet(f"{folder}/out").select("day", "slice", F.get_json_object("item", "$.id").cast("int").alias("id"), "complete").collect()
    assert sorted((r.day, r.slice, r.id) for r in rows) == _wanted() and all(r.complete for r in rows)


def test_offsets_admit_pages_and_agree_on_any_split(api, tmp_path):
    """However many pages a trigger admits, the pages between its offsets make up the window, each once."""
    pages = lambda parts, lists: [r[:2] + (r[3], r[5]) for p in parts for r in lists.rows(p)]
    for admitted in (1, 2, 3, 7, 100):
        r = paged._StreamReader(_options(api, pagesPerTrigger=str(admitted), progress=str(tmp_path / str(admitted))))
        at, got = r.initialOffset(), []
        while True:
            to = r.latestOffset()
            if to == at:
                break
            parts = r.partitions(at, to)
            rows = pages(parts, r.lists)
            assert len({x[:3] for x in rows}) <= admitted
            assert pages(r.partitions(at, to), r.lists) == rows  # a repeated batch reads the same
            got, at = got + rows, to
        assert sorted((d, s, json.loads(i)["id"]) for d, s, _, i in got) == _wanted() and at == {"window": "2020-01-01", "day": "2020-01-06", "page": 0, "slice": None}
    again = paged._StreamReader(_options(api, progress=str(tmp_path / "3")))
    assert again.latestOffset() == at
    with pytest.raises(ValueError, match="behind the stream's own"):
        again.partitions(at, again.initialOffset())
    other = paged._StreamReader({**_options(api, progress=str(tmp_path / "3")), "start": "2020-01-02"})
    with pytest.raises(ValueError, match="window of 2020-01-01"):
        other.latestOffset()
    with pytest.raises(ValueError, match="progress"):
        paged._StreamReader(_options(api))


def test_progress_is_kept_whole(tmp_path):
    p = paged._Progress(str(tmp_path / "p"))
    assert p.last() is None
    for i in range(30):
        p.give(Cursor("2020-01-01", "2020-01-02", i, "a:b"))
    (tmp_path / "p" / "000000000099.new").write_text("{half")
    assert p.last() == Cursor("2020-01-01", "2020-01-02", 29, "a:b") and len(p._files()) <= 10


def test_filters_reach_the_server(spark, api):
    paged.register(spark)
    df = spark.read.format("paged_list").options(**_options(api, fields='{"state": ["stateIs", "state.text"]}')).load()
    _Lists.asked.clear()
    some = df.where("day >= '2020-01-02' and day < '2020-01-04' and state = 'shut' and slice like '%y'")
    assert sorted(json.loads(r.item)["id"] for r in some.collect()) == [30, 31, 32, 33]
    assert {a["at"] for a in _Lists.asked} == {"2020-01-02", "2020-01-03"} and all(a.get("stateIs") == "shut" for a in _Lists.asked)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if "Pushed" in line]
    filters = [line for line in plan.splitlines() if "Condition" in line]
    assert pushed and all(x in pushed[0] for x in ("2020-01-02", "2020-01-04", "shut")), plan
    assert any("EndsWith" in f for f in filters) and not any("2020-01-02" in f or "shut" in f for f in filters), plan
    for cond, days in (("day = '2020-01-04'", {"2020-01-04"}), ("day in ('2020-01-04', '2020-01-01', '1999-01-01')", {"2020-01-01", "2020-01-04"}), ("day > '2020-01-04'", {"2020-01-05"}), ("day <= '2020-01'", set())):
        _Lists.asked.clear()
        got = {r.day for r in df.where(cond).collect()}
        assert {a["at"] for a in _Lists.asked} == days and got == days - {"2020-01-05"}, cond
    assert {json.loads(r.item)["id"] for r in df.where("state <> 'open'").collect()} == {30, 31, 32, 33, 40}
    assert df.where("state = 'open' and state = 'shut'").count() == 0


def test_gate_spaces_requests_and_opens_after_failures():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    def failing(request, timeout):
        calls.append(now[0])
        raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)

    gate = http.Gate(concurrency=2, spacing=0.5, threshold=3, cooldown=60, clock=lambda: now[0], sleep=sleep)
    with pytest.raises(http.CircuitOpen):
        http.ask("http://x", {}, tries=9, base=0.01, opener=failing, sleep=lambda s: None, gate=gate)
    assert calls == [0.0, 0.5, 1.0] and slept == [0.5, 0.5]
    with pytest.raises(http.CircuitOpen):  # refused without a request
        http.ask("http://x", {}, opener=failing, gate=gate)
    assert len(calls) == 3
    now[0] += 61
    import io

    assert http.ask("http://x", {}, opener=lambda *a, **k: io.BytesIO(b"{}"), gate=gate) == {} and gate.failures == 0
    for _ in range(9):  # answers below 500 are no failures of the server

        def missing(request, timeout):
            raise urllib.error.HTTPError(request.full_url, 404, "no", {}, None)

        with pytest.raises(urllib.error.HTTPError):
            http.ask("http://x", {}, opener=missing, gate=gate)
    gate.check("http://x")


def test_gate_bounds_requests_at_once():
    import time

    gate, at_once, most = http.Gate(concurrency=3, spacing=0.0), [0], [0]

    def slow():
        with gate:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
            time.sleep(0.02)
            at_once[0] -= 1

    threads = [threading.Thread(target=slow) for _ in range(12)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert most[0] == 3
