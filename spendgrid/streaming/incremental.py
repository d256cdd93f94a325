"""Incremental operators: content-version deduplication, late data, corrections, idempotent batches, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_versions(stream: DataFrame, key: Sequence[str] = ("source", "external_id", "endpoint_version", "content_hash")) -> DataFrame:
    """Each content version once, for ever; the state holds one entry for each version."""
    return stream.dropDuplicates(list(key))


def new_within(stream: DataFrame, at: str, key: Sequence[str], lookback: str = "2 days") -> DataFrame:
    """Each key once within a trailing look-back; older state is dropped, later rows are late."""
    return stream.withWatermark(at, lookback).dropDuplicatesWithinWatermark(list(key))


def open_corrections(rows: DataFrame, key: str, at: str, is_open: Column, now: Column, days: int = 30, legacy: bool = False) -> DataFrame:
    """The latest row of each key in the last days that is still open. legacy filters before it looks for the latest, and so
    keeps keys whose latest row is closed."""
    recent = rows.where(F.col(at) > now - F.make_dt_interval(F.lit(days)))
    recent = recent.where(is_open) if legacy else recent
    rest = [c for c in rows.columns if c != key]
    last = recent.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))
    return last if legacy else last.where(is_open)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], expect: Column | None = None) -> StreamingQuery:
    """Process what has arrived, in order, and stop. A batch that holds a row against `expect` fails before it is written, and the
    cursor stays; `write` gets each batch with its number and must be idempotent by it."""

    def step(batch: DataFrame, number: int) -> None:
        if expect is not None and batch.where(~F.coalesce(expect, F.lit(False))).limit(1).count():
            raise ValueError(f"batch {number} holds rows against the expectation")
        write(batch, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, length: str, slide: str | None, *keys: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums of value in tumbling or sliding windows of event time."""
    e = events.withWatermark(at, watermark) if watermark else events
    w = F.window(at, length, slide) if slide else F.window(at, length)
    g = e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, *keys: str, watermark: str | None = None) -> DataFrame:
    e = events.withWatermark(at, watermark) if watermark else events
    g = e.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def with_details(lists: DataFrame, details: DataFrame, key: str, at: str, detail_at: str, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows of a stream of lists with the columns of their details (another stream, key of the same name), which may come up to `within` before or after them; a list row whose details
    did not come by then goes without, a detail without its list goes nowhere.

    A left outer join of two streams: the state holds rows until both watermarks (their times less `delay`) have passed them by `within`, and no longer. Null keys meet nothing. Columns of both streams but the
    key must differ in name."""
    left = lists.withWatermark(at, delay)
    right = details.withColumnRenamed(key, f"_{key}").withWatermark(detail_at, delay)
    near = F.col(detail_at).between(F.col(at) - F.expr(f"INTERVAL {within}"), F.col(at) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col(f"_{key}")) & near, "left_outer").drop(f"_{key}")
