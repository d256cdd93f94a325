import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from spendgrid.operators import flags, search, serving, silver, sinks, spend, treemap
from spendgrid.sources import bson, catalogs, paged
from spendgrid.streaming import incremental


def test_pair_spend_splits_a_consortium(spark):
    da = spark.createDataFrame([(1, 7, 10.0, dt.datetime(2020, 1, 1)), (None, 7, 5.0, None), (1, None, 5.0, None)], "authority_id long, supplier_id long, closing double, finalization timestamp")
    contracts = spark.createDataFrame([(100, 1, 90.0, dt.datetime(2020, 2, 1)), (101, None, 9.0, None)], "contract_id long, authority_id long, value double, state_date timestamp")
    winners = spark.createDataFrame([(100, 7), (100, 8), (100, 9), (101, 7)], "contract_id long, supplier_id long")
    got = sorted((r.src, r.supplier_id, r.full, r.split) for r in spend.pair_spend(da, contracts, winners).collect())
    assert got == [("contract", 7, 90.0, 30.0), ("contract", 8, 90.0, 30.0), ("contract", 9, 90.0, 30.0), ("da", 7, 10.0, 10.0)]


def test_year_totals_tell_missing_years_from_all_time(spark):
    s = spark.createDataFrame([("a", dt.datetime(2020, 5, 1), 1.0), ("a", None, 2.0)], "kind string, at timestamp, value double")
    got = sorted(((r.year or 0), r.all_time, r.n, r.total) for r in spend.totals_by_year(s).collect())
    assert got == [(0, 0, 1, 2.0), (0, 1, 2, 3.0), (2020, 0, 1, 1.0)]


def test_concentration_of_zero_totals(spark):
    p = spark.createDataFrame([(1, 1, 0.0), (2, 1, 3.0), (2, 2, 1.0)], "authority_id long, supplier_id long, x double")
    got = {r.authority_id: (r.partners, r.top_pct, r.hhi) for r in spend.shares(spend.concentration(p, F.col("x"))).collect()}
    assert got == {1: (1, None, None), 2: (2, 0.75, 0.625)}


def test_top_k_breaks_ties_by_id(spark):
    d = spark.createDataFrame([("r", 3, 1.0), ("r", 1, 1.0), ("r", 2, None), ("r", 4, 9.0)], "role string, id long, v double")
    assert [(r.id, r.rank) for r in spend.top_by(d, ["role"], "v", 3, "id").orderBy("rank").collect()] == [(4, 1), (1, 2), (3, 3)]


def _da(spark, rows):
    return spark.createDataFrame([(str(i), a, s, c, p, f, d) for i, (a, s, c, p, f, d) in enumerate(rows)], "da_id string, authority_id long, supplier_id long, closing decimal(18,2), publication timestamp, finalization timestamp, division string")


def test_rapid_and_round_edges(spark):
    from decimal import Decimal

    t, m = dt.datetime(2020, 3, 1, 12), lambda n: dt.datetime(2020, 3, 1, 12) + dt.timedelta(minutes=n)
    da = _da(spark, [(1, 1, None, t, m(5), "15"), (1, 1, Decimal(10), t, m(60), "15"), (1, 1, Decimal(10), m(5), t, "15"), (1, 1, Decimal(3_000_000), t, m(1), "15"), (1, 1, Decimal("119267.10"), t, m(90), "15"), (1, 1, Decimal(132_519), t, m(90), "15"), (1, 1, Decimal(132_519), t, m(90), "45"), (1, 1, Decimal(400_000), t, m(90), "45")])
    assert {r.da_id: r.minutes for r in flags.rapid(da, flags.Limits()).collect()} == {"0": 5}
    assert sorted(r.da_id for r in flags.round_value(da, flags.Limits()).collect()) == ["4", "7"]
    codes = {(r.flag_code, r.subject_id) for r in flags.all_flags(da, flags.Limits()).collect()}
    assert ("da_rapid", "0") in codes and ("da_round", "4") in codes
    r = flags.risk_index(da, flags.Limits()).where("role = 'authority'").first()
    assert r.n == 6 and "da_round" in r.codes and r.cri == round(len(r.codes) / 5, 4)


def test_thresholds_by_day(spark):
    t = catalogs.thresholds(spark)
    assert t.count() == 15
    at = lambda y: {r.key: float(r.value_num) for r in flags.thresholds_at(t, F.lit(f"{y}-01-01").cast("timestamp")).collect()}
    assert at(2019)["da_ceiling_works"] == 441730 and at(2023)["da_ceiling_works"] == 900400
    facts = spark.createDataFrame([(1, dt.datetime(2019, 1, 1)), (2, dt.datetime(2023, 1, 1)), (3, dt.datetime(2000, 1, 1)), (4, None)], "i int, d timestamp")
    got = {r.i: r.c and float(r.c) for r in flags.with_threshold(facts, "d", t, "da_ceiling_goods_services", "c").collect()}
    assert got == {1: 132519.0, 2: 270120.0, 3: None, 4: None}


def test_archive_counts(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(s, h) for s, h in x], "source string, content_hash string")
    path, key = f"{tmp_path}/raw", ["source", "content_hash"]
    assert sinks.append_new(rows(("a", "1"), ("a", "2")), path, key) == {"inserted": 2, "skipped": 0}
    assert sinks.append_new(rows(("a", "1"), ("a", "2")), path, key) == {"inserted": 0, "skipped": 2}
    assert sinks.append_new(rows(("a", "3"), ("a", "3"), ("a", "1")), path, key) == {"inserted": 1, "skipped": 2}
    ledger = spark.createDataFrame([("x", 100, 98), ("y", None, 5)], "source string, reported long, fetched long")
    assert [r.deviation for r in sinks.with_deviation(ledger).orderBy("source").collect()] == [2, None]


def test_replays_and_versions(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, "list", "n1", None), (1, 2, "detail", None, "t2"), (1, 3, "list", "n3", None), (2, 4, "detail", None, "t4")], "id long, raw long, kind string, name string, type string")
    got = sinks.latest_by_part(r, ["id"], {"l": (F.col("kind") == "list", ["name"]), "d": (F.col("kind") == "detail", ["type"])}, "raw")
    assert sorted(map(tuple, got.collect())) == [(1, "n3", "t2"), (2, None, "t4")]
    assert sorted((x.id, x.raw) for x in sinks.latest(r, ["id"], "raw").collect()) == [(1, 3), (2, 4)]
    sinks.publish(r.where("id = 1"), f"{tmp_path}/v")
    sinks.publish(r.where("id = 2"), f"{tmp_path}/v")
    assert sinks.published(spark, f"{tmp_path}/v").count() == 1
    with pytest.raises(ValueError, match="still match"):
        sinks.rewrite(r, lambda d: d, F.col("name").isNotNull())


def test_payloads_to_facts(spark):
    import json

    raw = [
        (1, "award-contracts:v1", json.dumps({"caNoticeId": 5, "items": [{"caNoticeContractId": 50, "contractValue": 12.5, "winners": [{"entityId": 1, "name": "A"}, {"entityId": 2, "name": "B"}]}, {"caNoticeContractId": 51, "winner": {"entityId": 3, "name": "C"}}, {"contractNo": "no key"}]})),
        (2, "da-list:v1", json.dumps({"directAcquisitionId": 9, "contractingAuthority": "29074847 Gradinita", "supplier": "RO21255449 X", "cpvCode": "15800000-6 - D", "closingValue": 7, "extra": 1, "finalizationDate": "2020-01-02T03:04:05"})),
        (3, "da-detail:v1", json.dumps({"directAcquisitionID": 9, "cpvCode": {"text": "t", "localeKey": "45453000-7"}, "directAcquisitionItems": [{"directAcquisitionItemID": 1, "itemMeasureUnit": " BUCATĂ"}, {"directAcquisitionItemID": 2, "itemMeasureUnit": "x"}]})),
        (4, "da-list:v1", "{broken"),
        (5, "tender-list:v1", json.dumps({"cNoticeId": 77, "contractingAuthorityNameAndFN": "4291638 - COMUNA C", "cpvCodeAndName": "99999999-9 x", "estimatedValueRon": 3})),
    ]
    df = spark.createDataFrame(raw, "raw_id long, endpoint_version string, payload string")
    c = silver.contracts_of(silver.parsed(df, "award-contracts:v1"))
    assert sorted((w.contract_id, w.source_id) for w in silver.winners_of(c).collect()) == [(50, 1), (50, 2), (51, 3)]
    good, bad = sinks.quarantine(silver.parsed(df, "da-list:v1"), silver.natural_key("da-list:v1").isNull(), F.lit("no key"))
    assert [r.raw_id for r in bad.collect()] == [4] and bad.first().excerpt == "{broken"
    a = silver.acquisitions_of(good, "da-list:v1").first()
    assert (a.da_id, a.cpv_code, float(a.closing), str(a.finalization)) == (9, "15800000-6", 7.0, "2020-01-02 03:04:05")
    d = silver.parsed(df, "da-detail:v1")
    assert silver.acquisitions_of(d, "da-detail:v1").first().cpv_code == "45453000-7"
    units = spark.createDataFrame([("bucata", "buc", 1.0)], "pattern string, unit string, factor double")
    assert sorted((i.item_id, i.unit) for i in silver.items_of(d, units).collect()) == [(1, "buc"), (2, None)]
    n = silver.notices_of(silver.parsed(df, "tender-list:v1"), "tender-list:v1")
    assert (n.first().authority_code, n.first().authority_name) == ("4291638", "COMUNA C")
    v = silver.with_cpv(n.withColumnRenamed("cpv_code", "raw_cpv"), "raw_cpv", spark.createDataFrame([("15800000-6",)], "code string")).first()
    assert v.cpv_valid is False and v.cpv_code is None


def test_resolution(spark):
    m = [(1, "s", 10, "RO21255449", "A"), (2, "s", 10, None, "A2"), (3, "s", 11, "21255449", "A3"), (4, "s", 10, "29074847", "other"), (5, None, None, "29074847", "B"), (6, None, None, "DE811569869", "C"), (7, None, None, "DE811569869", "C"), (8, "s", 12, None, "D")]
    df = spark.createDataFrame([(*x, None, dt.datetime(2020, 1, x[0])) for x in m], "ord long, namespace string, source_id long, code_raw string, name string, county string, seen_at timestamp")
    orgs, conflicts = silver.resolve_organisations(df)
    got = {r.entity_key: r for r in orgs.collect()}
    assert len(got) == 4 and got["code:21255449"].source_ids == [10, 11] and got["code:21255449"].name == "A"
    assert got["code:29074847"].name == "B" and got["id:s:12"].code is None
    assert [(r.owned, r.other) for r in conflicts.collect()] == [("21255449", "29074847")]


def test_suggestions_keep_ordinals_apart(spark):
    e = spark.createDataFrame([(1, "gradinita nr 4 lugoj", False), (2, "gradinita nr 5 lugoj", False), (3, "gradinita lugoj", True), (4, "gradinita lugojj", True)], "id long, name string, code_valid boolean")
    assert sorted((r.a, r.b) for r in silver.name_suggestions(e).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4)]


def test_serving(spark):
    assert serving.digits_only("12") == 12 and serving.digits_only("1 or 1=1") == 0
    tree = spark.createDataFrame([("a", None, 5.0), ("b", "a", 3.0), ("c", "a", 0.0), ("d", "b", 2.0)], "code string, parent_code string, total double")
    assert [r.code for r in serving.children(tree, None).collect()] == ["a"] and [r.code for r in serving.children(tree, "a").collect()] == ["b"]
    up = serving.ancestry(tree, tree.where("code = 'd'").select("code")).orderBy("depth").collect()
    assert [r.ancestor for r in up] == ["d", "b", "a"]
    v = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert serving.quantile_bounds(v, "v").first().bounds == [3.0, 5.0, 7.0, 9.0]
    many = [(i * 7919) % 1000 / 7 if i % 3 else 5.0 for i in range(3001)]  # a third of all values are one
    ranked, df = sorted(many), spark.createDataFrame([(x,) for x in [*many, None]], "v double")
    for cells in (2, 16, 256):
        assert serving.quantile_bounds(df, "v", 5, cells).first().bounds == [ranked[k * len(ranked) // 5] for k in range(1, 5)]
    assert serving.quantile_bounds(df.limit(0), "v").first().bounds == []


def test_search(spark):
    p = spark.createDataFrame([(1, "supplier", "Școala Generală", "123", 5.0), (1, "authority", "Școala Generală", "123", 9.0), (2, "supplier", "Scoli Unite", "456", 1.0), (3, "supplier", "Altceva", "123", 1.0)], "entity_id long, role string, name string, code string, total double").withColumn("county", F.lit("X"))
    docs = search.documents(p)
    index = search.tokens(docs)
    assert {r.entity_id: r.total for r in docs.collect()}[1] == 9.0
    assert search.search(docs, index, "scoala genrala").first().entity_id == 1
    ids = lambda *a, **k: [r.entity_id for r in search.search(docs, index, *a, **k).collect()]
    assert all(ids(q) == ids(q, typos=search.typo_keys(index)) for q in ("scoala genrala", "123", "sco", "gneerala scola"))
    assert [r.entity_id for r in search.search(docs, index, "123").collect()] == [1, 3] and search.search(docs, index, "  ").count() == 0
    assert [r.entity_id for r in search.search(docs, index, "sco", role="authority").collect()] == [1]


def test_treemap_fills_its_rectangle():
    tiles = treemap.layout([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert abs(sum(w * h for *_, w, h in tiles) - 24) < 1e-9 and max(max(w / h, h / w) for *_, w, h in tiles) < 3.5
    assert [round(w * h, 6) for *_, w, h in tiles] == [6, 6, 4, 3, 2, 2, 1] and treemap.layout([], 0, 0, 1, 1) == []


def test_bson(spark, tmp_path):
    docs = [{"_id": i, "name": f"n{i}", "x": i / 2, "big": 2**40 + i, "when": dt.datetime(2020, 1, 1, tzinfo=dt.UTC), "flag": True, "none": None, "list": [1, "a"], "doc": {"k": 1}} for i in range(40)]
    raw = b"".join(map(bson.encode, docs))
    assert bson.decode(raw)[0] == docs[0]
    (tmp_path / "a.bson").write_bytes(raw)
    (tmp_path / "b.bson").write_bytes(raw + struct.pack("<i", 0) + raw)
    spark.dataSource.register(bson.BsonDump)
    read = lambda name, **o: spark.read.format("bson_dump").schema("_id long, name string, x double, big long, flag boolean, gone string").options(**o).load(str(tmp_path / name))
    a = read("a.bson", chunkBytes=500)
    assert a.rdd.getNumPartitions() > 3 and a.count() == 40 and a.where("_id = 3").first() == (3, "n3", 1.5, 2**40 + 3, True, None)
    assert read("b.bson").count() == 40  # stops at the bad length
    assert read("b.bson", resume="chunk", chunkBytes=len(raw) + 4).count() == 80  # goes on with the next chunk


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<R><CPV CODE="1-1"><TEXT LANG="EN">en</TEXT><TEXT LANG="RO">ro &amp; x</TEXT></CPV><CPV CODE="2-2"><TEXT LANG="EN">only</TEXT></CPV><CPV CODE="3-3"><TEXT LANG="DE">d</TEXT></CPV></R>')
    assert {r.code: r.name for r in catalogs.cpv_xml(spark, str(tmp_path / "c.xml")).collect()} == {"1-1": "ro & x", "2-2": "only", "3-3": "3-3"}
    (tmp_path / "c.json").write_text('[{"code": "1-1", "name": "a"}]')
    assert catalogs.cpv_json(spark, str(tmp_path / "c.json")).first().name == "a"
    roots = spark.createDataFrame([("A", 3.0, '[{"_id":"B","total":2.0,"children":[{"_id":"C","total":1.0}]},{"_id":"D","total":1.0}]')], "_id string, total double, children string")
    assert sorted((r.code, r.parent_code, r.level, r.n_children) for r in catalogs.tree_rows(roots).collect()) == [("A", None, 0, 2), ("B", "A", 1, 1), ("C", "B", 2, 0), ("D", "A", 1, 0)]


def test_slices_and_pages():
    full = {(), ("c2",)}
    over = lambda f: tuple(f.values()) in full
    assert paged.slices(lambda f: False, ["c1"], list) == [({}, True)]
    got = paged.slices(over, ["c1", "c2", "c3"], lambda c: ["k201", "k202"])
    assert [tuple(f.values()) for f, _ in got] == [("c1",), ("c2", "k201"), ("c2", "k202"), ("c3",)] and all(ok for _, ok in got)
    day = lambda i: i["d"]
    assert paged.check_page({"items": [{"d": "2020-01-02"}]}, "2020-01-01", day, exact=False)
    for bad in ({"items": [{"d": "2020-01-02"}]}, {"items": [], "searchTooLong": True}, {}):
        with pytest.raises(ValueError):
            paged.check_page(bad, "2020-01-01", day, exact=True)


def test_retries():
    import io
    import urllib.error

    calls, slept = [], []

    def opener(request, timeout):
        calls.append(request.data)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {"Retry-After": "2"} if len(calls) == 1 else {}, None)
        return io.BytesIO(b'{"total": 1, "items": []}')

    assert paged.post("http://example.org", {"a": 1}, opener=opener, sleep=slept.append)["total"] == 1
    assert slept[0] == 2 and 0.75 <= slept[1] <= 1.25


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = lambda *x: spark.createDataFrame(list(x), "k string, h string, at timestamp")
    t = lambda d: dt.datetime(2020, 1, d)
    rows(("a", "1", t(1)), ("a", "1", t(1)), ("b", "1", t(2))).write.parquet(src)

    def run(expect=None):
        s = spark.readStream.schema("k string, h string, at timestamp").parquet(src)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        incremental.run_available(incremental.new_versions(s, ["k", "h"]), f"{tmp_path}/cp", write, expect).awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 2
    rows(("a", "1", t(3)), ("a", "2", t(3))).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 3
    rows(("c", None, t(4))).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="against the expectation"):
        run(F.col("h").isNotNull())
    r = spark.createDataFrame([(1, t(20), "open"), (1, t(25), "closed"), (2, t(26), "open")], "k long, at timestamp, s string")
    now = F.lit(t(30))
    assert [x.k for x in incremental.open_corrections(r, "k", "at", F.col("s") == "open", now).collect()] == [2]
    assert sorted(x.k for x in incremental.open_corrections(r, "k", "at", F.col("s") == "open", now, legacy=True).collect()) == [1, 2]
