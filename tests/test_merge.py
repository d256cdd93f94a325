"""Merging on read: batches in any order equal one replay, and the base is not shuffled."""

import random

from spendgrid.operators import merge, sinks
from pyspark.sql import functions as F


def _rows(spark, seed, n):
    r = random.Random(seed)
    data = [(r.randint(0, 60), i, r.choice(["list", "detail"]), f"s{r.randint(0, 9)}", r.randint(0, 99) if r.random() < 0.8 else None) for i in range(n)]
    r.shuffle(data)
    return spark.createDataFrame(data, "id long, turn long, kind string, state string, value long")


PARTS = {"header": ["state"], "detail": ["value", "kind"]}
def _sets():
    return {"detail": F.col("kind") == "detail"}


def _replay(rows):
    groups = {"header": (F.lit(True), ["state"]), "detail": (F.col("kind") == "detail", ["value", "kind"])}
    return sorted(map(tuple, sinks.latest_by_part(rows, ["id"], groups, "turn").collect()))


def _table(spark, tmp_path):
    return merge.MergedTable(spark, str(tmp_path / "t"), ["id"], PARTS, ["turn"], buckets=4)


def test_batches_equal_a_replay(spark, tmp_path):
    rows, t = _rows(spark, 1, 400), _table(spark, tmp_path)
    for i in range(5):
        t.append(rows.where(F.col("turn") % 5 == i), f"b{i}", _sets())
        if i in (1, 3):
            t.compact()
        if i == 2:
            t.append(rows.where(F.col("turn") % 5 == i), "b2", _sets())  # a repeated batch, one still a change
            t.append(rows.where(F.col("turn") % 5 == 0), "b0", _sets())  # and one within the base
    assert sorted(map(tuple, t.read().select("id", "state", "value", "kind").collect())) == _replay(rows)
    again = merge.MergedTable(spark, str(tmp_path / "t"), ["id"], PARTS, ["turn"], buckets=4)
    again.compact()
    assert sorted(map(tuple, again.read().select("id", "state", "value", "kind").collect())) == _replay(rows) and again._state()["changes"] == {}


def test_the_base_is_not_shuffled(spark, tmp_path):
    rows, t = _rows(spark, 2, 300), _table(spark, tmp_path)
    t.append(rows.where("turn < 200"), "old", _sets())
    t.compact()
    t.append(rows.where("turn >= 200"), "new", _sets())
    df = t.read()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "merged_base" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, last = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < last:
            above.append(line)
            last = depth(line)
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line or "ShuffleQueryStage" in line for line in above[: join + 1]), plan
    assert sum("Exchange hashpartitioning" in line for line in lines) >= 1  # of the changes


def test_awkward_rows(spark, tmp_path):
    t = _table(spark, tmp_path)
    odd = spark.createDataFrame([(None, 1, "list", "x", 1), (1, 2, "list", None, None), (2, 5, "detail", "z", 7), (2, 5, "detail", "z", 7)], "id long, turn long, kind string, state string, value long")
    t.append(odd, "a", _sets())
    t.append(odd.where("false"), "b", _sets())
    want = [(1, None, None, None), (2, "z", 7, "detail")]
    assert sorted(map(tuple, t.read().select("id", "state", "value", "kind").collect())) == want
    t.compact()
    t.append(odd.where("id = 1").withColumns({"turn": F.lit(1).cast("long"), "state": F.lit("older")}), "c", _sets())
    assert sorted(map(tuple, t.read().select("id", "state", "value", "kind").collect())) == want
