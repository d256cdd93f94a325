"""Queries over all of their rows and all of each row, against brute force on small fixtures."""

import datetime as dt
import hashlib
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest
from spendgrid import plans
from spendgrid.sources import paged


def test_redact_hash_reads_whole_pages(spark, tmp_path):
    far = "<p>x</p>" * 700
    rows = [(1, "http://a", far + " write to jo.doe@mail.example.org now"), (2, "http://a", far + "one"), (3, "http://a", far + "two"), (4, "http://a", far + "two"), (5, "http://b", "short a@b.ro"), (6, "http://c", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.redacted, r.content_hash) for r in plans.QUERIES["redact_hash"](spark, str(tmp_path)).collect()}

    def brute(url, html):
        clean = lambda t: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email redactat]", t)
        text = json.dumps({k: clean(v) for k, v in (("html", html), ("url", url)) if v is not None}, ensure_ascii=False, separators=(",", ":"))
        return text, hashlib.sha256(text.encode()).hexdigest()

    assert got == {i: brute(url, html) for i, url, html in rows}
    assert "[email redactat]" in got[1][0] and got[2][1] != got[3][1] and got[3][1] == got[4][1]


def test_local_day_over_both_changes_of_the_clock(spark, tmp_path):
    # the zone goes from UTC+2 to UTC+3 at 2024-03-31 01:00 UTC and back at 2024-10-27 01:00 UTC
    at = ["2024-03-30 21:59", "2024-03-30 22:00", "2024-03-31 20:59", "2024-03-31 21:00", "2024-07-01 20:59", "2024-07-01 21:00", "2024-10-26 20:59", "2024-10-26 21:00", "2024-10-27 21:59", "2024-10-27 22:00"]
    day = ["2024-03-30", "2024-03-31", "2024-03-31", "2024-04-01", "2024-07-01", "2024-07-02", "2024-10-26", "2024-10-27", "2024-10-27", "2024-10-28"]
    rows = [(i, dt.datetime.fromisoformat(t), 1, "view", 1.0, "{}") for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.day: r.n for r in plans.QUERIES["local_day"](spark, str(tmp_path)).collect()}
    assert got == {d: day.count(d) for d in day}


def test_orphans_are_made_on_the_side_of_the_organisations(spark):
    plan = plans.QUERIES["join_orphans_dropped"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "% " in line]
    assert filters and all("entity_id" in f and "authority_id" not in f for f in filters)


class _Lists(BaseHTTPRequestHandler):
    """At most 4 items a search. Day 1 has few items; day 2 overflows, as do its category b and the code b2; day 3 gives another day's."""

    items = [("2020-01-01", "a", "a1", i) for i in range(3)] + [("2020-01-02", "a", "a1", i) for i in range(10, 14)] + [("2020-01-02", "b", "b1", i) for i in range(20, 23)] + [("2020-01-02", "b", "b2", i) for i in range(30, 36)] + [("2020-01-03", "a", "a1", 40)]

    def do_POST(self):  # noqa: N802
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        hit = [x for x in self.items if x[0] == ask["at"] and ask.get("cpvCategoryId", x[1]) == x[1] and ask.get("cpvCodeId", x[2]) == x[2]]
        first = ask["pageIndex"] * ask["pageSize"]
        shown = [{"id": i, "at": "2020-01-09" if d == "2020-01-03" else d} for d, _, _, i in hit[:4][first : first + ask["pageSize"]]]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"total": len(hit), "items": shown, "searchTooLong": len(hit) > 4}).encode())

    def log_message(self, *a):
        pass


def test_paged_lists_split_overflowing_days_and_mark_what_is_lost(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Lists)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedList)
    read = lambda a, b, **o: spark.read.format("paged_list").options(url=f"http://127.0.0.1:{server.server_port}", start=a, end=b, dateField="at", pageSize="2", **o).load()
    try:
        df = read("2020-01-01", "2020-01-02", categories='{"a": ["a1"], "b": ["b1", "b2"]}')
        got = sorted((r.day, r.slice, r.complete, json.loads(r.item)["id"]) for r in df.collect())
        assert df.rdd.getNumPartitions() == 4
        want = [("2020-01-01", "day", True, i) for i in range(3)] + [("2020-01-02", "a", True, i) for i in range(10, 14)] + [("2020-01-02", "b:b1", True, i) for i in range(20, 23)] + [("2020-01-02", "b:b2", False, i) for i in range(30, 34)]
        assert got == want
        assert {r.complete for r in read("2020-01-02", "2020-01-02").collect()} == {False}
        with pytest.raises(Exception, match="holds an item of 2020-01-09"):
            read("2020-01-03", "2020-01-03").collect()
    finally:
        server.shutdown()


@pytest.mark.parametrize(("name", "scans"), [("da_transactions", 1), ("cri", 1), ("flag_counts", 1)])
def test_flags_read_the_acquisitions_once_beside_the_shared_sums(spark, name, scans):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and sum("l_shipdate" in line and "Relation" in line for line in plan.splitlines()) == scans


def test_search_is_no_nested_loop(spark):
    df = plans.QUERIES["search"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_codes_of_imported_acquisitions_are_steps_of_their_own(spark):
    """Inlined into each digit of their check they made code beyond what is compiled (281 replacements)."""
    plan = plans.QUERIES["import_acquisitions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 100


def _bought(spark, folder, lines):
    """Small tables of acquisitions: lines (order, part, supplier, price), each order of a customer of its own."""
    day = dt.datetime(1996, 3, 1)
    rows = [(o, p, s, 1, 2.0, price, "A", day + dt.timedelta(days=90)) for o, p, s, price in lines]
    orders = [(o, o + 1, "F", 10.0 * o, day, "5-LOW") for o in sorted({x[0] for x in lines})]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(p, "STANDARD") for p in sorted({x[1] for x in lines})], "p_partkey long, p_type string").write.parquet(f"{folder}/part.parquet")


def _by_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.sql(plans.ORACLE_SQL[name]).fetchall())


def test_items_whose_numbers_meet_are_all_kept(spark, tmp_path):
    """Parts with keys of six digits and more: several pairs of order and part have the number 400007 in the SQL."""
    _bought(spark, tmp_path, [(0, 400_007, 1, 10.5), (2, 200_007, 1, 20.25), (4, 7, 1, 30.0), (4, 7, 2, 1.0), (4, 100_007, 1, 5.0), (4, 1_199_999, 3, 7.0), (5, 300_007, 1, 9.0)])
    got = sorted(tuple(r) for r in plans.QUERIES["normalize_items"](spark, str(tmp_path)).collect())
    assert [r[0] for r in got].count(400_007) == 3 and len(got) == 5
    assert got == _by_sql(tmp_path, "normalize_items", "orders", "lineitem")


def test_flags_that_nothing_sets_are_counted_as_none(spark, tmp_path):
    codes = {"da_rapid", "da_round", "da_split", "da_concentration", "da_dependence", "da_year_end"}
    for name, lines in (("few", [(0, 1, 1, 10.5), (1, 2, 2, 79_000.0), (2, 2, 2, 20.25)]), ("none", [(0, 1, 1, 10.5)])):
        _bought(spark, tmp_path / name, lines)
        got = sorted(tuple(r) for r in plans.QUERIES["flag_counts"](spark, str(tmp_path / name)).collect())
        assert {code for code, _ in got} == codes and got == _by_sql(tmp_path / name, "flag_counts", "orders", "lineitem", "part")
        assert (dict(got)["da_round"], dict(got)["da_split"]) == (int(name == "few"), 0)
