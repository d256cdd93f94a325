"""Transactional tables: Parquet files of tasks that count from the moment when one manifest names them.

`df.write.format("versioned_table").mode("append").option("base", n).save(folder)`: each task writes a file of its own, the driver's commit adds the manifest of version n + 1, which succeeds
for one writer only (an exclusive name), and an aborted or refused write deletes its files. Readers take the files that manifests name (read_version), so they see whole versions and never
what a task left behind. append_unique() appends rows whose key is new, and repeats only the look at what others committed meanwhile. Folders lie in local or shared file systems, or in stores whose
rename refuses an existing name (HDFS)."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.sinks import new_rows
from ..session import stored


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _place(folder: str) -> tuple[store.FileSystem, str]:
    return store.FileSystem.from_uri(folder) if ":" in folder else (store.LocalFileSystem(), os.path.abspath(folder))


def _manifests(folder: str) -> list[str]:
    where, at = _place(folder)
    return sorted(f.path for f in where.get_file_info(store.FileSelector(f"{at}/log", allow_not_found=True)) if f.base_name.endswith(".json"))


def latest_version(folder: str) -> int:
    """The last committed version, 0 before the first."""
    found = _manifests(folder)
    return int(found[-1].rsplit("/", 1)[1][:-5]) if found else 0


def manifest(folder: str, version: int) -> dict:
    where, at = _place(folder)
    with where.open_input_stream(f"{at}/log/{version:012d}.json") as f:
        return json.loads(f.read())


def _add_manifest(folder: str, version: int, told: dict) -> None:
    where, at = _place(folder)
    where.create_dir(f"{at}/log", recursive=True)
    made, final = f"{at}/log/{uuid.uuid4().hex}.new", f"{at}/log/{version:012d}.json"
    with where.open_output_stream(made) as f:
        f.write(json.dumps(told).encode())
    try:
        if isinstance(where, store.LocalFileSystem):
            os.link(made, final)  # fails if the name exists, whoever made it
        elif where.get_file_info(final).type != store.FileType.NotFound:
            raise FileExistsError(final)
        else:
            where.move(made, final)
            return
    except OSError as e:
        where.delete_file(made)
        raise Conflict(f"version {version} of {folder} exists") from e
    where.delete_file(made)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, base: int, schema: StructType, token: str):
        self.folder, self.base, self.schema, self.write_id = folder, base, schema.json(), token

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, at = _place(self.folder)
        name, out, rows = f"{self.write_id}-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if out is None:
                    where.create_dir(f"{at}/data", recursive=True)
                    out = pq.ParquetWriter(f"{at}/data/{name}", batch.schema, filesystem=where, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                where.delete_file(f"{at}/data/{name}")
            raise
        if out is not None:
            out.close()
            if where.get_file_info(f"{at}/data/{self.write_id}.aborted").type != store.FileType.NotFound:
                where.delete_file(f"{at}/data/{name}")  # this task ends after its write was given up
        return _Written(name if rows else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        told = [m for m in messages if m is not None and m.path]
        try:
            _add_manifest(self.folder, self.base + 1, {"files": [m.path for m in told], "rows": sum(m.rows for m in told), "schema": self.schema, "token": self.write_id})
        except Conflict:
            self.abort(messages)
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Deletes all files of this write, those of tasks that did not report as well; tasks that still run find a mark and delete their own."""
        where, at = _place(self.folder)
        where.create_dir(f"{at}/data", recursive=True)
        with where.open_output_stream(f"{at}/data/{self.write_id}.aborted"):
            pass
        for f in where.get_file_info(store.FileSelector(f"{at}/data", allow_not_found=True)):
            if f.base_name.startswith(self.write_id) and f.base_name.endswith(".parquet"):
                where.delete_file(f.path)


class VersionedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versioned_table"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("versioned tables are appended to")
        folder = self.options["path"]
        return _Writer(folder, int(self.options.get("base", latest_version(folder))), schema, self.options.get("token", uuid.uuid4().hex))


def vacuum(folder: str, older: float = 86_400.0) -> int:
    """Delete files that no manifest names and that are older than so many seconds (longer than any write takes), such as those of killed workers; returns their number."""
    where, at = _place(folder)
    named = {name for n in range(1, latest_version(folder) + 1) for name in manifest(folder, n)["files"]}
    gone = [f.path for f in where.get_file_info(store.FileSelector(f"{at}/data", allow_not_found=True)) if f.base_name not in named and time.time() - f.mtime.timestamp() >= older]
    for path in gone:
        where.delete_file(path)
    return len(gone)


def read_version(spark: SparkSession, folder: str, version: int | None = None, after: int = 0) -> DataFrame | None:
    """The rows of all versions up to one (by default the last) behind `after`; None if there are none."""
    last = latest_version(folder) if version is None else version
    told = [manifest(folder, n) for n in range(after + 1, last + 1)]
    if not told:
        return None
    schema = StructType.fromJson(json.loads(told[-1]["schema"]))
    paths = [f"{folder}/data/{name}" for m in told for name in m["files"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    """Make versioned_table known to a session, and the session to this thread: Spark looks sources up in the thread's active one."""
    with _registering:
        SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
        spark.dataSource.register(VersionedTable)


def append_unique(incoming: DataFrame, folder: str, key: Sequence[str], tries: int = 20) -> dict[str, int]:
    """Append the rows whose key the table lacks, one for each key, as one version; returns the counts inserted and skipped and the version (that found, if nothing was new).

    Writers may work at the same time: who loses a version drops from its rows the keys that the winners added, and tries the next one. Null keys are equal to nothing and are not stored twice from one
    batch only."""
    spark = incoming.sparkSession
    register(spark)
    base = latest_version(folder)
    fresh = stored(new_rows(incoming, read_version(spark, folder, base), key), "fresh")
    total = incoming.count()
    for _ in range(tries):
        inserted = fresh.count()
        if not inserted:
            return {"inserted": 0, "skipped": total, "version": base}
        token = uuid.uuid4().hex
        try:
            fresh.write.format("versioned_table").mode("append").options(base=str(base), token=token).save(folder)
        except Exception:
            if latest_version(folder) == base:
                raise  # nobody was faster: the write itself failed
        if manifest(folder, base + 1)["token"] == token:
            return {"inserted": inserted, "skipped": total - inserted, "version": base + 1}
        seen = base
        base = latest_version(folder)
        others = read_version(spark, folder, base, after=seen)
        fresh = stored(new_rows(fresh, others, key), "fresh")
    raise Conflict(f"{folder}: lost {tries} versions in a row")
