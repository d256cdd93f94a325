"""Look-ups against a small server, cursors, published versions, resets, canonical JSON."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from spendgrid.functions.payloads import canonical
from spendgrid.operators import importing, serving, sinks
from spendgrid.sources import catalogs, lookups
from spendgrid.streaming import cursors


class _Api(BaseHTTPRequestHandler):
    """Details by id (7 is broken, 8 busy once), contracts and codes by skip and take."""

    busy = {"8"}

    def _answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):  # noqa: N802
        i = self.path.rsplit("/", 1)[1]
        if i in self.busy:
            self.busy.discard(i)
            return self._answer(503, {})
        self._answer(404 if i == "7" else 200, {"id": int(i), "ü": 1})

    def do_POST(self):  # noqa: N802
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        n = 5 if "category" in ask else ask["id"]
        told = n + 1 if n == 3 else n  # notice 3 tells of a contract that it does not give
        self._answer(200, {"total": told, "items": [{"code": f"{ask.get('category')}{i}", "n": i} for i in range(ask["skip"], min(ask["skip"] + ask["take"], n))]})

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def api():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_details_keep_rows_whose_look_up_fails(spark, api):
    rows = spark.createDataFrame([(1, 1), (7, 1), (8, 1), (9, 2), (None, 1)], "id long, version int")
    out = lookups.with_details(rows, api + "/d/{id:.0f}", "id", F.col("version") == 2, pause=0.01)
    got = {r.id: (r.detail and json.loads(r.detail)["id"], bool(r.error)) for r in out.collect()}
    assert got == {1: (1, False), 7: (None, True), 8: (8, False), 9: (None, False), None: (None, False)}
    assert lookups.fetch_counts(out).first().asDict() == {"seen": 5, "fetched": 2, "failed": 1, "deferred": 2}


def test_contracts_and_codes_page_by_page(spark, api):
    out = lookups.with_contracts(spark.createDataFrame([(0,), (2,), (3,), (5,)], "id long"), api, "id", take=2, pause=0.01)
    got = {r.id: (r.contracts and len(json.loads(r.contracts)), r.error) for r in out.collect()}
    assert got[0] == (0, None) and got[2] == (2, None) and got[5] == (5, None) and got[3][0] is None and "3 of 4" in got[3][1]
    codes = lookups.catalog_codes(spark.createDataFrame([("a",), ("b",), ("a",)], "category string"), api, take=2).collect()
    assert sorted(r.code for r in codes) == sorted(f"{c}{i}" for c in "ab" for i in range(5))


def test_cursors_resume_their_own_window_only(spark, tmp_path):
    c = cursors.Cursor("2024-01-01", "2024-01-03", 2, "a:b")
    assert cursors.Cursor.of(c.text()) == c and cursors.resumed(c, "2024-01-01") == c
    assert cursors.resumed(c, "2024-01-02") == cursors.Cursor("2024-01-02", "2024-01-02") and c.after_day() == cursors.Cursor("2024-01-01", "2024-01-04")
    for bad in ("{}", "[]", "x", '{"window": "2024-01-01", "day": "soon", "page": 0}', '{"window": "2024-01-01", "day": "2024-01-01", "page": -1}'):
        with pytest.raises(ValueError, match="corrupt"):
            cursors.Cursor.of(bad)
    assert list(cursors.chunks("2024-01-01", "2024-01-05", 2)) == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-05")]
    folder, batch = str(tmp_path), spark.createDataFrame([(1,), (2,)], "id long")
    assert cursors.read_cursor(spark, folder, "das") is None
    at = cursors.Cursor("2024-01-01", "2024-01-01")
    for _ in range(2):  # a repeated commit does not double the batch
        cursors.commit(batch, folder, "das", at, at.after_page())
    cursors.commit(batch, folder, "other", at, at.after_day())
    assert cursors.read_cursor(spark, folder, "das") == at.after_page() and cursors.read_cursor(spark, folder, "other").day == "2024-01-02"
    assert cursors.committed(spark, folder).where("source = 'das'").count() == 2


def test_published_versions_appear_whole(spark, tmp_path):
    folder = f"{tmp_path}/v"
    sinks.publish(spark.range(3), folder)
    spark.range(99).write.parquet(f"{folder}/half-written")
    assert sinks.published(spark, folder).count() == 3
    sinks.publish(spark.range(5), folder)
    assert sinks.published(spark, folder).count() == 5


def test_reset_keeps_what_it_is_told_to(spark):
    spark.sql("create database if not exists derived")
    for t in ("facts", "codes"):
        spark.range(4).write.mode("overwrite").saveAsTable(f"derived.{t}")
    assert catalogs.key_difference(["b", "a", "c"], ["c", "z"]) == ["a", "b"]
    assert catalogs.reset(spark, ["derived"], ["codes"]) == ["derived.facts"]
    assert spark.table("derived.facts").count() == 0 and spark.table("derived.codes").count() == 4


def test_trees_of_any_depth(spark):
    node = {"_id": "99", "total": 1.0, "children": []}
    for level in range(98, 89, -1):
        node = {"_id": str(level), "total": 2.0, "children": [node]}
    roots = spark.createDataFrame([("90", 2.0, json.dumps(node["children"])), ("SEAP", 1.0, None)], "_id string, total double, children string")
    got = {r.code: (r.parent_code, r.level, r.n_children) for r in importing.tree(roots).collect()}
    assert got["99"] == ("98", 10, 0) and got["90"] == (None, 1, 1) and len(got) == 10


def test_canonical_json_as_browsers_write_it():
    assert canonical({"b": 1.0, "a": [1e-7, 0.000001, 1e21, 123456789012345680.0, 1.5, -0.0, True, None]}) == '{"a":[1e-7,0.000001,1e+21,123456789012345680,1.5,0,true,null],"b":1}'
    assert canonical({"": 1, "\U0001f389": 2, "a": {}}) == '{"a":{},"\U0001f389":2,"":1}'  # by UTF-16 units
    assert canonical(2**53 + 1) == "9007199254740992" and canonical("é\n") == '"é\\n"'


def test_reports_and_coverage(spark):
    assert json.loads(serving.report(serving.row_counts({"b": spark.range(3), "a": spark.range(0)}))) == {"a": 0, "b": 3}
    t = spark.createDataFrame([("Iași ", 30.0), ("IASI", 20.0), ("nowhere", 50.0)], "county string, total double")
    got = serving.coverage(t, spark.createDataFrame([("iasi", "Iași"), ("cluj", "Cluj")], "key string, label string")).collect()
    assert {(r.key, r.total, r.coverage) for r in got} == {("iasi", 50.0, 50.0), ("cluj", 0.0, 50.0)}


def test_contracts_of_more_than_a_thousand_winners_keep_their_own(spark):
    from spendgrid.operators import normalize

    who = lambda a, n: [{"entityId": i, "name": f"w{i}"} for i in range(a, a + n)]
    items = [{"caNoticeContractId": k, "caNoticeId": 1, "winners": who(a, n)} for k, a, n in ((1, 0, 1002), (2, 5000, 2), (3, 6000, 1))]
    raw = spark.createDataFrame([(1, "award-contracts:v1", json.dumps({"caNoticeId": 1, "items": items}))], "raw_id long, endpoint_version string, payload string")
    none = spark.createDataFrame([], "code string"), spark.createDataFrame([], "pattern string, unit string, factor double")
    got = normalize.normalize(raw, *none, "award-contracts:v1").tables["contract_winners"]
    assert {r.contract_id: r["count"] for r in got.groupBy("contract_id").count().collect()} == {1: 1002, 2: 2, 3: 1}


def test_payloads_are_parsed_once(spark, monkeypatch):
    """One table for each kind holds what its payloads say; no result parses again."""
    from spendgrid.operators import normalize
    from spendgrid.plans import build
    from spendgrid.sources.views import Views

    v, names = Views(spark, "/root/testdata/sf0.001"), []
    real = normalize.stored
    monkeypatch.setattr(normalize, "stored", lambda df, name: names.append(name) or real(df, name))
    s = normalize.normalize(build._acquisitions(v), build._catalog(v), build._units(v))
    assert names.count("parsed") == len(normalize.ORDER)
    for df in (*s.tables.values(), s.quarantine, s.report):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_counted_while_they_are_written(spark, tmp_path):
    """The ledger holds what was written, and no row is made twice for it."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(1000).mapInArrow(count, "id long").where("id % 4 > 0")
    told = sinks.record_run(spark, str(tmp_path / "t"), "r1", "src", rows, str(tmp_path / "ledger"), reported=800)
    assert told["fetched"] == 750 and made.value == 1000 and sinks.published(spark, str(tmp_path / "t")).count() == 750
    row = sinks.with_deviation(spark.read.schema(sinks.LEDGER).parquet(str(tmp_path / "ledger"))).first()
    assert (row.run_id, row.reported, row.fetched, row.deviation) == ("r1", 800, 750, 50) and row.started <= row.finished
    empty = sinks.publish_observed(spark.range(5).where("id > 9"), str(tmp_path / "e"), n=F.count(F.lit(1)), most=F.max("id"))
    assert empty["n"] == 0 and empty["most"] is None


def test_lists_wait_for_their_details(spark, tmp_path):
    """Details before, after and without their list, too late ones, and lists without any."""
    import datetime as dt

    from spendgrid.streaming import incremental

    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    lists = [("a", t(8), 1), ("b", t(8), 2), ("c", t(9), 3), ("d", t(10), 4), (None, t(10), 5), ("z", t(20), 9)]
    details = [("a", t(8, 30), "after"), ("b", t(7, 15), "before"), ("c", t(11), "too late"), ("x", t(9), "no list"), (None, t(10), "null"), ("zz", t(20), "end")]
    spark.createDataFrame(lists, "k string, at timestamp, n long").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame(details, "k string, told timestamp, d string").write.parquet(str(tmp_path / "d"))
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    out = incremental.with_details(read("l", "k string, at timestamp, n long"), read("d", "k string, told timestamp, d string"), "k", "at", "told")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.k, r.n, r.d) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, "after"), ("b", 2, "before"), ("c", 3, None), ("d", 4, None), (None, 5, None)}
