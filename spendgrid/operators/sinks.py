"""Idempotent appends, replays, partial updates, quarantine, versioned overwrites and the run ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """incoming without rows whose key is stored already, one row for each key; what an append may add."""
    once = incoming.dropDuplicates(list(key))
    return once if existing is None else once.join(existing.select(*key), list(key), "left_anti")


def append_new(incoming: DataFrame, path: str, key: Sequence[str]) -> dict[str, int]:
    """Append what is new to a Parquet table; returns the counts inserted and skipped."""
    spark = incoming.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        existing = None
    # written once beside the table: its count is exact whoever else appends meanwhile, and costs no scan
    fresh = stored(new_rows(incoming, existing, key), "fresh")
    inserted = fresh.count()
    fresh.write.mode("append").parquet(path)
    return {"inserted": inserted, "skipped": incoming.count() - inserted}


def latest(rows: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns (a replay of upserts). Rows are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col("_row")[c].alias(c) for c in rest))


def latest_by_part(rows: DataFrame, key: Sequence[str], parts: Mapping[str, tuple[Column, Sequence[str]]], *order: str) -> DataFrame:
    """The last values of groups of columns that different kinds of rows carry.

    parts names each group: the condition on rows that set it, and its columns. A key without such a row has nulls in it."""
    aggs = [F.max_by(F.when(cond, F.struct(*cols)), F.when(cond, F.struct(*order))).alias(name) for name, (cond, cols) in parts.items()]
    best = rows.groupBy(*key).agg(*aggs)
    return best.select(*key, *(F.col(name)[c].alias(c) for name, (_, cols) in parts.items() for c in cols))


def quarantine(rows: DataFrame, bad: Column, reason: Column, payload: str = "payload", excerpt: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; bad ones keep a reason and the start of their payload."""
    marked = rows.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    kept = [c for c in rows.columns if c != payload]
    return marked.where("not _bad").drop("_bad"), marked.where("_bad").select(*kept, reason.alias("reason"), F.substring(payload, 1, excerpt).alias("excerpt"))


def publish(df: DataFrame, folder: str) -> str:
    """Write a new version of a table, then append its name to the folder's list of versions. Appending adds one whole file, so readers see
    the old version or the new one at any time, and a version that failed half-way is never listed."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    listed = spark.createDataFrame([(time.time_ns(), version)], "at long, version string").coalesce(1)
    listed.write.mode("append").parquet(f"{folder}/VERSIONS")
    return version


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The latest published version."""
    version = spark.read.parquet(f"{folder}/VERSIONS").agg(F.max_by("version", F.struct("at", "version")).alias("v")).first()["v"]
    return spark.read.parquet(f"{folder}/{version}")


def publish_observed(df: DataFrame, folder: str, **metrics: Column) -> dict:
    """publish(), and what the job saw while it wrote: the version with the values of metrics (aggregates by name); no second pass over the rows."""
    seen = Observation(f"published-{uuid.uuid4().hex}")
    version = publish(df.observe(seen, *(m.alias(name) for name, m in metrics.items())), folder)
    return {"version": version, **seen.get}


LEDGER = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("started", T.TimestampType()), T.StructField("finished", T.TimestampType()), T.StructField("reported", T.LongType()), T.StructField("fetched", T.LongType())])


def record_run(spark: SparkSession, folder: str, run_id: str, source: str, df: DataFrame, ledger: str, reported: int | None = None, clock=lambda: datetime.now(UTC)) -> dict:
    """Publish df as a run of a source and append its row to the ledger (a Parquet table): when it started and finished, how many rows the source reported and how many were written,
    as counted by the writing job itself."""
    started = clock()
    told = publish_observed(df, folder, fetched=F.count(F.lit(1)))
    row = (run_id, source, started, clock(), reported, told["fetched"])
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return told


def with_deviation(ledger: DataFrame) -> DataFrame:
    """Runs with reported - fetched; null where the source reported no total."""
    return ledger.withColumn("deviation", F.col("reported") - F.col("fetched"))


def rewrite(rows: DataFrame, change, leak: Column) -> DataFrame:
    """rows after change(rows); fails if a row still matches `leak`."""
    out = change(rows)
    left = out.where(leak).limit(1).count()
    if left:
        raise ValueError("rows still match the pattern that had to go")
    return out
