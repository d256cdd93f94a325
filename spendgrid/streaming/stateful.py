"""Keyed streams with a value and a timer for each key: transitions of a state within a rescan window, and the latest row of a key while it is recent.

State is bounded: a key is forgotten when the watermark passes its last row by the window. Both need the RocksDB state store, which with_state_store() sets for the queries that it starts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB; the session's own setting comes back behind it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _ms(at: datetime) -> int:
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def _row(at: datetime, id_: int, state: str | None) -> tuple:
    """A row's (at, id, state), its time without a zone, as what comes back from the store has one."""
    return (at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at), id_, state


class _Keyed(StatefulProcessor):
    """Keeps the last row of a key by (at, id), and a timer `days` behind it."""

    def __init__(self, days: float):
        self.window = timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, id long, state string")

    def keep(self, row: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(row)
        self.handle.registerTimer(_ms(row[0] + self.window))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(self.forgotten(key[0]))

    def forgotten(self, key) -> list[Row]:
        return []

    def close(self) -> None:
        pass


class _Transitions(_Keyed):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = _row(*self.last.get()) if self.last.exists() else None
        for r in sorted((_row(r["at"], r["id"], r["state"]) for r in rows), key=lambda r: r[:2]):
            if last is not None and r[:2] <= last[:2]:
                continue  # late, or there already
            if last is not None and r[0] - last[0] <= self.window and r[2] != last[2]:
                yield Row(key=key[0], id=r[1], at=r[0], before=last[2], state=r[2])
            last = r
        if last is not None:
            self.keep(last)


class _Latest(_Keyed):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = max((_row(r["at"], r["id"], r["state"]) for r in rows), key=lambda r: r[:2])
        if not self.last.exists() or new[:2] > _row(*self.last.get())[:2]:
            self.keep(new)
            yield Row(key=key[0], id=new[1], at=new[0], state=new[2])

    def forgotten(self, key) -> list[Row]:
        return [Row(key=key, id=None, at=None, state=None)]


def _named(stream: DataFrame, key: str, at: str, id_: str, state: str, delay: str) -> DataFrame:
    known = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(id_).isNotNull())
    return known.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(id_).cast("long").alias("id"), F.col(state).cast("string").alias("state")).withWatermark("at", delay)


def transitions(stream: DataFrame, key: str, at: str, id_: str, state: str, days: float = 45, delay: str = "1 day") -> DataFrame:
    """(key, id, at, before, state) of rows whose state differs (null-aware) from the row before of their key by (at, id), where that is at most `days` older.

    Rows of one micro-batch are put in order; rows that come in a later batch than a newer one of their key change nothing. Rows without a key, time or id are left out."""
    g = _named(stream, key, at, id_, state, delay).groupBy("key")
    return g.transformWithState(_Transitions(days), "key string, id long, at timestamp, before string, state string", "Append", "EventTime")


def latest_rows(stream: DataFrame, key: str, at: str, id_: str, state: str, days: float = 30, delay: str = "1 day") -> DataFrame:
    """(key, id, at, state): the latest row of a key whenever it changes, and a row without id when it is `days` old: what its last row here says of a key is so."""
    g = _named(stream, key, at, id_, state, delay).groupBy("key")
    return g.transformWithState(_Latest(days), "key string, id long, at timestamp, state string", "Update", "EventTime")
