"""As-of joins against a search of all periods, ancestors against walks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spendgrid.operators import asof


def _day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)


@pytest.mark.parametrize("slices", [1, 7])
def test_asof_against_all_periods(spark, slices):
    r = random.Random(slices)
    periods = {}
    for k in (*range(12), 99):
        starts = sorted(r.sample(range(-50, 300), r.randint(0, 20)))
        for i, a in enumerate(starts):
            end = starts[i + 1] if i + 1 < len(starts) else None
            periods[k, a] = (None if end is None or r.random() < 0.5 else max(a, end - r.randint(0, 9)), r.choice([None, r.randint(0, 99)]))
    facts = [(i, r.choice([0, 0, 0, *range(14), None]), r.choice([None, *range(250)])) for i in range(400)] + [(7, 0, 5)] * 2
    f = spark.createDataFrame([(i, k, None if h is None else _day(h), "old") for i, k, h in facts], "id long, k long, at timestamp, v string")
    p = spark.createDataFrame([(k, _day(a), None if b is None else _day(b), v) for (k, a), (b, v) in periods.items()] + [(None, _day(0), None, 1), (0, None, None, 1)], "k long, since timestamp, until timestamp, v long")

    def want(k, h):
        mine = [(a, b, v) for (q, a), (b, v) in periods.items() if q == k and h is not None and a <= h]
        if not mine:
            return None
        _, b, v = max(mine, key=lambda x: x[0])
        return v if b is None or h < b else None

    got = asof.asof_join(f, p, ["k"], "at", "since", ["v"], until="until", slices=slices)
    assert got.columns == ["id", "k", "at", "v"]
    assert sorted((x.id, str(x.k), str(x.at), str(x.v)) for x in got.collect()) == sorted((i, str(k), str(None if h is None else _day(h)), str(want(k, h))) for i, k, h in facts)
    assert asof.asof_join(f.where("false"), p, ["k"], "at", "since", ["v"]).count() == 0
    assert {x.v for x in asof.asof_join(f, p.where("false"), ["k"], "at", "since", ["v"]).collect()} == {None}


def test_many_periods_meet_no_range_join_and_a_hot_key_is_split(spark):
    p = spark.range(100_000).select((F.col("id") % 50).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("since"), F.col("id").alias("v"))
    f = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), F.timestamp_seconds(F.col("id") * 119 + 30).alias("at"))
    df = asof.asof_join(f, p, ["k"], "at", "since", ["v"], slices=32)
    # the last period of k by then: the largest number of its residue class up to the minute
    minute = F.floor(F.unix_timestamp("at") / 60)
    own = minute - F.pmod(minute - F.col("k"), F.lit(50))
    wrong = df.where(~F.col("v").eqNullSafe(F.when(own >= 0, F.least(own, F.lit(99_950) + F.col("k")))))
    assert wrong.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    parts = df.groupBy("k", F.floor(F.unix_timestamp("at") * 32 / (50_000 * 119)).alias("s")).count().agg(F.max("count")).first()[0]
    assert parts < 50_000 / 3 / 16


def test_ancestors_of_deep_trees(spark, monkeypatch):
    rows = [(f"n{i}", f"n{i - 1}" if i % 45 else None) for i in range(135)] + [("leaf", "n44"), ("lost", "nowhere"), (None, "n1"), ("n3", "n2")]
    rounds = []
    real = asof.stored
    monkeypatch.setattr(asof, "stored", lambda df, name: rounds.append(name) or real(df, name))
    got = {(r.code, r.ancestor, r.depth) for r in asof.ancestors(spark.createDataFrame(rows, "code string, parent_code string")).collect()}
    up = {a: b for a, b in rows if a and b}
    want = set()
    for a in {a for a, _ in rows if a}:
        at, d = a, 0
        while at:
            want.add((a, at, d))
            at, d = up.get(at), d + 1
    assert got == want and rounds.count("ancestors") <= 7


def test_ancestors_of_circles_end(spark):
    got = asof.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "code string, parent_code string"), most=5).collect()
    assert {(r.code, r.ancestor, r.depth) for r in got} == {(x, x if d % 2 == 0 else y, d) for x, y in (("a", "b"), ("b", "a")) for d in range(6)}
    assert asof.ancestors(spark.createDataFrame([], "code string, parent_code string")).count() == 0
