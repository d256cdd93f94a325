"""Any split of mentions into batches resolves like one run, and only touched organisations change."""

import datetime as dt
import random

import pytest

from spendgrid.operators import resolution, silver

SCHEMA = "ord long, namespace string, source_id long, code_raw string, name string, county string, seen_at timestamp"
VALID = ["21255449", "16020748", "29074847", "RO21255449"]


def _mentions(seed, n):
    r = random.Random(seed)
    return [(i, r.choice(["supplier", "authority", "winner"]), r.choice([None, 1, 2, 3, 4]), r.choice([None, *VALID, "DE811569869", ""]), r.choice(["A", "B", None]), r.choice(["Iași", None]), r.choice([None, dt.datetime(2020, 1, 1 + i % 28)])) for i in range(n)]


def _rows(df):
    cols = ["entity_key", "code", "code_valid", "name", "county", "code_variants", "source_ids", "first_seen", "last_seen", "entity_id"]
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_run(spark, tmp_path, seed):
    rows = _mentions(seed, 60)
    want, conflicts = silver.resolve_organisations(spark.createDataFrame(rows, SCHEMA))
    want = want.fillna({"code_valid": False})
    r, order = random.Random(seed), list(range(4))
    r.shuffle(order)
    state = resolution.Resolution(spark, str(tmp_path / "r"), buckets=2)
    cut = {i: [x for x in rows if x[0] % 4 == i] for i in order}
    versions = []
    for i in order:
        versions.append(state.append(spark.createDataFrame(cut[i], SCHEMA), f"b{i}"))
        if i == order[1]:
            state.compact()
    state.append(spark.createDataFrame(cut[order[0]], SCHEMA), f"b{order[0]}")  # a batch that comes again
    assert _rows(state.organisations()) == _rows(want)
    assert sorted(map(tuple, state.conflicts().select("namespace", "source_id", "owned", "other").collect())) == sorted(map(tuple, conflicts.collect()))


def test_only_touched_organisations_are_grouped_anew(spark, tmp_path):
    state = resolution.Resolution(spark, str(tmp_path / "r"), buckets=2)
    first = [(10, "supplier", 1, None, "A", None, None), (11, "supplier", 2, "16020748", "B", None, None), (12, "winner", 3, "21255449", "C", None, None)]
    v = state.append(spark.createDataFrame(first, SCHEMA), "a")
    state.append(spark.createDataFrame([(20, "supplier", 1, "RO21255449", "A2", None, None)], SCHEMA), "b")  # id 1 turns out to be the organisation of winner 3
    changed, gone = state.touched(v)
    assert [(r.entity_key, r.name, r.source_ids) for r in changed.collect()] == [("code:21255449", "A", [1, 3])] and [r.entity_key for r in gone.collect()] == ["id:supplier:1"]
    assert len(state.organisations().collect()) == 2
