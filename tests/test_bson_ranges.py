"""Dumps cut at any bytes: ranges find the same documents as one pass over the lengths, whatever the files hold."""

import random
import struct

import pytest

from spendgrid.sources import bson


def _docs(seed, n):
    """Documents with nested ones, empty ones, zeros in strings' places, and binaries that are dumps themselves."""
    r, out = random.Random(seed), []
    for i in range(n):
        d = {"_id": i, "name": "x" * r.randint(0, 60), "doc": {"a": {"b": [1, {"c": "é" * r.randint(0, 9)}]}, "e": {}}, "list": list(range(r.randint(0, 5)))}
        raw = bson.encode(d)
        if r.random() < 0.15:
            inner = b"".join(bson.encode({"_id": 10_000 + k, "name": "inner"}) for k in range(r.randint(1, 40)))
            body = raw[4:-1] + b"\x05bin\0" + struct.pack("<iB", len(inner), 0) + inner
            raw = struct.pack("<i", len(body) + 5) + body + b"\0"
        out.append(raw)
    return out


def _read(spark, path, table, chunk, schema="_id long, name string", **options):
    wrong = bson.split_dump(spark, path, table, chunk, resume=options.get("resume", ""))
    bson.register(spark)
    return spark.read.format("bson_dump").schema(schema).options(ranges=table, **options).load(path), wrong


def _chain(raw):
    """Ids along the lengths, to the first bad one."""
    at, out = 0, []
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from("<i", raw, at)
        if n < 5 or at + n > len(raw):
            break
        out.append(bson.decode(raw, at, wanted={"_id"})[0]["_id"])
        at += n
    return out


@pytest.mark.parametrize("chunk", [300, 100_000])
def test_ranges_agree_on_whole_and_damaged_files(spark, tmp_path, chunk):
    r = random.Random(chunk)
    files = {"a": b"".join(_docs(1, 60)), "b": b"".join(_docs(2, 1)), "empty": b""}
    cut = _docs(3, 50)
    files["bad"] = b"".join(cut[:25]) + struct.pack("<i", 3) + b"".join(cut[25:])
    files["tail"] = b"".join(_docs(4, 15))[:-3]
    files["noise"] = b"".join(cut[:20]) + bytes(r.randrange(256) for _ in range(900))
    for name, raw in files.items():
        (tmp_path / f"{name}.bson").write_bytes(raw)
    df, _ = _read(spark, str(tmp_path), str(tmp_path / "ranges"), chunk)
    assert sorted(x["_id"] for x in df.collect()) == sorted(i for raw in files.values() for i in _chain(raw))
    where = bson.files(str(tmp_path))[0]
    want = {name: bson.starts(where, str(tmp_path / f"{name}.bson"), 1 << 30, None)[-1][1] for name in ("a", "b")}
    ranges = spark.read.parquet(str(tmp_path / "ranges")).collect()
    for name, size in want.items():
        mine = sorted((x.begin, x.stop) for x in ranges if x.path.endswith(f"/{name}.bson"))
        assert mine[0][0] == 0 and mine[-1][1] == size and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))


def test_values_that_are_dumps_are_found_out(spark, tmp_path):
    """A range that starts within a binary full of documents takes them for the file's; the range before it knows better."""
    inner = b"".join(bson.encode({"_id": 10_000 + k, "name": "inner"}) for k in range(400))
    body = b"\x10_id\0" + struct.pack("<i", 1) + b"\x05bin\0" + struct.pack("<iB", len(inner), 0) + inner
    big = struct.pack("<i", len(body) + 5) + body + b"\0"
    (tmp_path / "x.bson").write_bytes(bson.encode({"_id": 0}) + big + b"".join(bson.encode({"_id": i}) for i in range(2, 30)))
    told = []
    for chunk in (1500, 3100, 9000):
        df, wrong = _read(spark, str(tmp_path / "x.bson"), str(tmp_path / f"ranges{chunk}"), chunk)
        assert sorted(x["_id"] for x in df.collect()) == list(range(30))
        told.append(wrong)
    assert any(told)


def test_reading_goes_on_behind_damage(spark, tmp_path):
    docs = [bson.encode({"_id": i, "name": f"n{i}"}) for i in range(200)]
    raw = b"".join(docs[:50]) + b"\xff" * 33 + b"".join(docs[50:120]) + struct.pack("<i", 2) + b"".join(docs[120:])
    (tmp_path / "x.bson").write_bytes(raw)
    for chunk in (150, 1 << 20):
        df, _ = _read(spark, str(tmp_path / "x.bson"), str(tmp_path / f"ranges{chunk}"), chunk, resume="next")
        assert sorted(x["_id"] for x in df.collect()) == list(range(200))
        stop, _ = _read(spark, str(tmp_path / "x.bson"), str(tmp_path / f"stop{chunk}"), chunk)
        assert sorted(x["_id"] for x in stop.collect()) == list(range(50))


def test_conditions_are_checked_before_rows_are_made(spark, tmp_path):
    docs = [{"_id": i, "name": f"n{i % 7}", "x": i / 4, "flag": i % 2 == 0, "skip": [1, {"a": None}]} for i in range(60)] + [{"_id": None}, {"x": float("nan")}]
    bson.write_dump(spark.createDataFrame([(i, f"n{i % 7}") for i in range(40)], "_id long, name string").repartition(3), str(tmp_path / "w"))
    (tmp_path / "x.bson").write_bytes(b"".join(map(bson.encode, docs)))
    df, _ = _read(spark, str(tmp_path / "x.bson"), str(tmp_path / "ranges"), 200, "_id long, name string, x double, flag boolean")
    rows = df.collect()
    for cond in ("_id = 3", "_id in (1, 5, 99)", "name like 'n3%'", "x <= 2.5 and _id > 3", "x > 10", "flag = true and name >= 'n5'", "_id is not null", "_id is null", "not (_id = 4)", "name = 'n1' or _id = 2"):
        plain = spark.createDataFrame(rows, df.schema).where(cond).collect()
        assert sorted(map(repr, df.where(cond).collect())) == sorted(map(repr, plain)), cond
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df.where("_id > 3 and x > 1")._jdf.queryExecution(), "formatted")
    assert any("Pushed" in line and "3" in line for line in plan.splitlines())
    written, _ = _read(spark, str(tmp_path / "w"), str(tmp_path / "wranges"), 100)
    assert sorted(tuple(x) for x in written.collect()) == [(i, f"n{i % 7}") for i in range(40)]


def test_split_plans_without_reading(spark, tmp_path, monkeypatch):
    """The driver asks for names and sizes only."""
    (tmp_path / "x.bson").write_bytes(b"".join(bson.encode({"_id": i}) for i in range(100)))
    opened = []
    real = bson.starts
    monkeypatch.setattr(bson, "starts", lambda *a: opened.append(a) or real(*a))
    monkeypatch.setattr(bson, "boundary", lambda *a: opened.append(a))
    bson.split_dump(spark, str(tmp_path / "x.bson"), str(tmp_path / "ranges"), 1 << 20)
    assert not opened
