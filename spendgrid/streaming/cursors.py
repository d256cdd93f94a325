"""Durable cursors of day-by-day ingestion: where a window was left, how it goes on, and batches that are committed with their cursor."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """The next page to read: of which window, day and slice."""

    window: str
    day: str
    page: int = 0
    slice: str | None = None

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Cursor:
        """A cursor from its text; anything but a whole cursor is an error, as going on from a guess would skip data."""
        try:
            got = cls(**json.loads(text))
            date.fromisoformat(got.window), date.fromisoformat(got.day)
            fine = isinstance(got.page, int) and got.page >= 0 and (got.slice is None or isinstance(got.slice, str))
        except (TypeError, ValueError) as e:
            raise ValueError(f"corrupt cursor {text!r}") from e
        if not fine:
            raise ValueError(f"corrupt cursor {text!r}")
        return got

    def after_page(self) -> Cursor:
        return replace(self, page=self.page + 1)

    def after_day(self) -> Cursor:
        return Cursor(self.window, (date.fromisoformat(self.day) + timedelta(1)).isoformat())


def resumed(cursor: Cursor | None, start: str) -> Cursor:
    """Where a window that starts on this day goes on: at the cursor if that is the window's own, else at its beginning."""
    return cursor if cursor and cursor.window == start else Cursor(start, start)


def chunks(start: str, end: str, days: int) -> Iterator[tuple[str, str]]:
    """A window (both ends included) as windows of at most so many days, in order: one job each, the next one started by the one before."""
    at, last = date.fromisoformat(start), date.fromisoformat(end)
    while at <= last:
        stop = min(at + timedelta(days - 1), last)
        yield at.isoformat(), stop.isoformat()
        at = stop + timedelta(1)


_LOG = "source string, number long, cursor string"


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    """All cursors committed so far, None before the first."""
    try:
        return spark.read.schema(_LOG).parquet(f"{folder}/cursors")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def read_cursor(spark: SparkSession, folder: str, source: str) -> Cursor | None:
    """The last committed cursor of a source, None before its first commit."""
    log = _log(spark, folder)
    row = log.where(F.col("source") == source).agg(F.max_by("cursor", "number").alias("c")).first() if log else None
    return Cursor.of(row["c"]) if row and row["c"] else None


def commit(batch: DataFrame, folder: str, source: str, at: Cursor, following: Cursor) -> None:
    """Write a batch under the cursor that it was read at, then append the cursor that follows. A crash in between repeats the batch, which
    overwrites itself; readers take whole batches only."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{folder}/batches/source={source}/window={at.window}/batch={at.day}-{at.slice or 'day'}-{at.page}")
    log = _log(spark, folder)
    last = log.agg(F.max("number").alias("n")).first()["n"] if log else None
    number = 0 if last is None else last + 1
    spark.createDataFrame([(source, number, following.text())], _LOG).coalesce(1).write.mode("append").parquet(f"{folder}/cursors")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """All batches, with their source, window and batch."""
    return spark.read.parquet(f"{folder}/batches")
