"""Keyed tables that are merged on read: a bucketed base and the changes since, joined without shuffling the base.

Rows set groups of columns (parts) of their key, each under an order; the last value of each part counts, whatever came in which batch. The base holds for each key and part the value
with its order, in buckets of the key; a batch is combined by key first, so that only its own rows are shuffled. Bases and changes count from the version that a manifest names
(sources.versioned), so a batch that fails half-way is never seen, and a batch that is repeated under its name is there once. compact() makes base and changes the next base."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versioned


@dataclass(frozen=True)
class Part:
    """Columns that are set together; the value of the last row by the order counts, or of the first one."""

    columns: Sequence[str]
    order: Sequence[str]
    first: bool = False


class MergedTable:
    """A keyed table in a folder that driver and executors share.

    parts names each group of columns (a Part, or columns under the table's order); rows given to append() tell with conditions which parts they set. collected names columns whose distinct
    values add up. buckets is fixed when the table is made: about one for each 128 MB that it may grow to."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], parts: Mapping[str, Sequence[str] | Part], order: Sequence[str] = (), buckets: int = 16, collected: Mapping[str, str] | None = None):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), list(key)
        self.parts = {p: c if isinstance(c, Part) else Part(list(c), list(order)) for p, c in parts.items()}
        self.buckets, self.collected = buckets, dict(collected or {})

    # ---- what is there

    def _state(self, version: int | None = None) -> dict:
        n = versioned.latest_version(self.folder) if version is None else version
        return versioned.manifest(self.folder, n) | {"version": n} if n else {"base": None, "changes": {}, "version": 0}

    def _bucketed(self, path: str, schema: str) -> DataFrame:
        """A table of this session over a folder of buckets, so that Spark knows how it is laid out."""
        name = "merged_" + path.rsplit("/", 1)[1].replace("-", "_")
        keys = ", ".join(f"`{k}`" for k in self.key)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _commit(self, state: dict, told: dict) -> None:
        versioned._add_manifest(self.folder, state["version"] + 1, told)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    # ---- changes

    def combined(self, rows: DataFrame, sets: Mapping[str, Column] | None = None) -> DataFrame:
        """One row a key: of each part the last value and its order, null where no row sets it; rows of null keys are left out."""
        on = {p: (sets or {}).get(p, F.lit(True)) for p in self.parts}
        aggs = []
        for p, part in self.parts.items():
            turn = F.struct(*(F.col(x).alias(f"o{i}") for i, x in enumerate(part.order)))
            best = F.min_by if part.first else F.max_by
            aggs.append(best(F.when(on[p], F.struct(turn.alias("o"), F.struct(*part.columns).alias("v"))), F.when(on[p], turn)).alias(p))
        aggs += [F.array_sort(F.collect_set(x)).alias(name) for name, x in self.collected.items()]
        known = rows
        for k in self.key:
            known = known.where(F.col(k).isNotNull())
        return known.groupBy(*self.key).agg(*aggs)

    def append(self, rows: DataFrame, batch: str, sets: Mapping[str, Column] | None = None, tries: int = 20) -> int:
        """Add a batch under a name of its own; returns the version. A name that is there already is written anew and counts once."""
        path = f"{self.folder}/change-{uuid.uuid4().hex}"
        made = self.combined(rows, sets)
        made.write.parquet(path)
        for _ in range(tries):
            state = self._state()
            told = {"base": state["base"], "changes": state["changes"] | {batch: path}, "schema": state.get("schema") or _ddl(made), "merged": state.get("merged", [])}
            if batch in told["merged"]:
                return state["version"]  # its rows are in the base
            try:
                self._commit(state, told)
                return state["version"] + 1
            except versioned.Conflict:
                continue
        raise versioned.Conflict(self.folder)

    # ---- reading

    def merged(self, version: int | None = None) -> DataFrame:
        """One row a key with its parts as (order, value), as of a version (by default the last)."""
        state = self._state(version)
        if not state["version"]:
            raise FileNotFoundError(f"{self.folder} holds no version yet")
        return self._merged(state)

    def _merged(self, state: dict) -> DataFrame:
        schema = state["schema"]
        base = self._bucketed(state["base"], schema) if state["base"] else None
        changes = self.spark.read.schema(schema).parquet(*state["changes"].values()) if state["changes"] else None
        if changes is None:
            return base if base is not None else self._empty(schema)
        best = [(F.min_by if part.first else F.max_by)(p, F.col(p)["o"]).alias(p) for p, part in self.parts.items()]
        late = changes.groupBy(*self.key).agg(*best, *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in self.collected))
        if base is None:
            return late
        held = [*self.parts, *self.collected]
        new = late.select(*(F.col(k).alias(f"_{k}") for k in self.key), *(F.col(p).alias(f"_{p}") for p in held)).repartition(self.buckets, *(F.col(f"_{k}") for k in self.key))
        both = base.join(new, [F.col(k) == F.col(f"_{k}") for k in self.key], "full")

        def chosen(p: str) -> Column:
            old, late_ = F.col(p), F.col(f"_{p}")
            wins = late_["o"] < old["o"] if self.parts[p].first else late_["o"] >= old["o"]
            return F.when(late_.isNull(), old).when(old.isNull() | wins, late_).otherwise(old).alias(p)

        sets = (F.array_sort(F.array_union(F.coalesce(name, f"_{name}"), F.coalesce(f"_{name}", name))).alias(name) for name in self.collected)
        return both.select(*(F.coalesce(k, f"_{k}").alias(k) for k in self.key), *map(chosen, self.parts), *sets)

    def changes(self, since: int) -> DataFrame:
        """What batches brought after a version, by key and batch."""
        known, paths = set(self._state(since)["changes"].values()), {}
        for n in range(since + 1, versioned.latest_version(self.folder) + 1):
            paths |= dict.fromkeys(p for p in self._state(n)["changes"].values() if p not in known)
        schema = self._state()["schema"]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self._empty(schema)

    def read(self) -> DataFrame:
        """The keys with the columns of all parts."""
        return self.merged().select(*self.key, *(F.col(p)["v"][c].alias(c) for p, part in self.parts.items() for c in part.columns), *self.collected)

    def compact(self) -> int:
        """Write base and changes as the next base; changes that come meanwhile stay changes. Returns the version."""
        state = self._state()
        path = f"{self.folder}/base-{uuid.uuid4().hex}"
        name = "merged_" + path.rsplit("/", 1)[1].replace("-", "_")
        self._merged(state).repartition(self.buckets, *self.key).write.format("parquet").bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", path).saveAsTable(name)
        for _ in range(20):
            now = self._state()
            left = {b: p for b, p in now["changes"].items() if state["changes"].get(b) != p}
            merged = sorted({*now.get("merged", []), *(b for b in state["changes"] if b not in left)})
            try:
                if now["base"] != state["base"]:
                    raise RuntimeError(f"{self.folder} was compacted by another meanwhile")
                self._commit(now, {"base": path, "changes": left, "schema": now["schema"], "merged": merged})
                return now["version"] + 1
            except versioned.Conflict:
                continue
        raise versioned.Conflict(self.folder)


def _ddl(df: DataFrame) -> str:
    return df.sparkSession._jsparkSession.parseDataType(df.schema.json()).toDDL()
