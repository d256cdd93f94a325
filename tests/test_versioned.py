"""Transactional tables: failing writes leave nothing, concurrent appends leave each key once."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from spendgrid.sources import versioned


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versioned.append_unique(spark.range(10).repartition(3), folder, ["id"]) == {"inserted": 10, "skipped": 0, "version": 1}
    before = sorted(os.listdir(f"{folder}/data"))
    bad = spark.range(100, 140).repartition(4).select(F.when(F.col("id") == 137, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("versioned_table").mode("append").save(folder)
    assert versioned.latest_version(folder) == 1 and versioned.read_version(spark, folder).count() == 10
    for _ in range(40):  # tasks that were running when the write was given up delete their own files
        left = sorted(x for x in os.listdir(f"{folder}/data") if x.endswith(".parquet"))
        if left == before:
            break
        time.sleep(0.25)
    assert left == before
    (tmp_path / "t" / "data" / "killed.parquet").write_bytes(b"half a file")
    assert versioned.vacuum(folder, 3600) == 0 and versioned.vacuum(folder, 0) == 2 and sorted(os.listdir(f"{folder}/data")) == before


def test_versions_are_taken_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    versioned.register(spark)
    write = lambda df, base: df.write.format("versioned_table").mode("append").option("base", base).save(folder)
    write(spark.range(3), 0)
    with pytest.raises(Exception, match="Conflict"):
        write(spark.range(3, 6), 0)  # its base is not the last version any more
    assert sum(x.endswith(".parquet") for x in os.listdir(f"{folder}/data")) == len(versioned.manifest(folder, 1)["files"])
    write(spark.range(3, 5), 1)
    assert versioned.read_version(spark, folder, 1).count() == 3 and versioned.read_version(spark, folder).count() == 5
    assert versioned.read_version(spark, folder, after=1).count() == 2 and versioned.read_version(spark, str(tmp_path / "none")) is None


def test_concurrent_appends_of_one_key_leave_one_row(spark, tmp_path):
    folder = str(tmp_path / "t")
    told, errors = [], []

    def append(k):
        try:
            told.append(versioned.append_unique(spark.range(k * 5, k * 5 + 12).withColumn("by", F.lit(k)), folder, ["id"]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=append, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors, errors
    rows = [r.id for r in versioned.read_version(spark, folder).collect()]
    assert sorted(rows) == list(range(27)) and sum(t["inserted"] for t in told) == 27 and sum(t["skipped"] for t in told) == 48 - 27
    made = [t["version"] for t in told if t["inserted"]]
    assert sorted(made) == list(range(1, len(made) + 1))
    assert versioned.append_unique(spark.range(5), folder, ["id"])["inserted"] == 0


def test_awkward_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, None, [1, 2]), (1, "x", None), (2, "y", [])], "id long, s string, `odd name` array<int>")
    assert versioned.append_unique(rows, folder, ["id"])["inserted"] == 2
    assert versioned.append_unique(rows.where("false"), folder, ["id"]) == {"inserted": 0, "skipped": 0, "version": 1}
    assert versioned.read_version(spark, folder).columns == ["id", "s", "odd name"]
