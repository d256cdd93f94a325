"""Keyed streams with values and timers, over several micro-batches."""

import datetime as dt

from spendgrid.streaming import stateful

SCHEMA = "user string, at timestamp, id long, state string"


def _day(n, h=0):
    return dt.datetime(2024, 1, 1, h) + dt.timedelta(days=n)


def _run(spark, tmp_path, make, batches, mode):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        with stateful.with_state_store(spark):
            q = make(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
        sizes.append(sum(p.numRowsTotal for p in q.lastProgress.stateOperators))
    return spark.read.parquet(out).collect(), sizes


def test_transitions_over_batches(spark, tmp_path):
    batches = [
        [("a", _day(0), 1, "open"), ("a", _day(2), 3, "shut"), ("a", _day(1), 2, "open"), ("b", _day(0), 4, None), (None, _day(0), 5, "x"), ("c", None, 6, "x")],
        [("a", _day(3), 7, "open"), ("a", _day(2), 3, "shut"), ("b", _day(3), 8, "open"), ("b", _day(3), 9, None), ("b", _day(3), 9, None)],
        [("d", _day(60), 10, "new")],
        [("d", _day(61), 11, "new"), ("a", _day(61), 12, "late state"), ("d", _day(62), 13, "done")],
    ]
    rows, sizes = _run(spark, tmp_path, lambda s: stateful.transitions(s, "user", "at", "id", "state", days=45), batches, "append")
    assert sorted((r.key, r.id, r.before, r.state) for r in rows) == [("a", 3, "open", "shut"), ("a", 7, "shut", "open"), ("b", 8, None, "open"), ("b", 9, "open", None), ("d", 13, "new", "done")]
    assert sizes[2] <= sizes[1]  # a and b went when d came


def test_latest_rows_are_forgotten(spark, tmp_path):
    batches = [[("a", _day(0), 1, "error"), ("a", _day(0), 2, "ok"), ("b", _day(1), 3, "error")], [("b", _day(0), 9, "older")], [("c", _day(50), 4, "error")], [("c", _day(50, 1), 5, "ok")]]
    rows, _ = _run(spark, tmp_path, lambda s: stateful.latest_rows(s, "user", "at", "id", "state", days=30), batches, "update")
    said = {}
    for r in sorted(rows, key=lambda r: r.batch):
        said.setdefault(r.key, []).append((r.id, r.state))
    assert said == {"a": [(2, "ok"), (None, None)], "b": [(3, "error"), (None, None)], "c": [(4, "error"), (5, "ok")]}
