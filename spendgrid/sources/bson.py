"""BSON dumps as a Spark data source: `spark.read.format("bson_dump").schema(...).load(path)`.

A dump is a run of length-prefixed documents. It is cut at any bytes into ranges of `chunkBytes`; each range finds its first document by itself (boundary()), and
split_dump() makes sure as a Spark job that the document before it ends there, so that ranges agree whatever a file holds; `ranges` names the table that it writes. Without that
option one pass of the driver over the lengths does the same for small files. By default reading stops at a file's first bad length; option `resume` = "next" goes on with the next
whole documents, "chunk" drops the rest of the chunk. Option `maxBytes` bounds how much of each file is read (profiling samples). Only the schema's fields are decoded, and conditions on them
are checked before a row is made where register() has set Spark to push filters. Paths are local or the URI of a store that pyarrow opens (file, hdfs, s3, gs, abfs), a file,
a folder of .bson files, or a pattern of file names."""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Collection, Iterable, Iterator
from datetime import UTC, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

#: Bytes of the values that have one size, by type.
_FIXED = {0x01: 8, 0x06: 0, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x7F: 0, 0xFF: 0}

_TYPES = {*_FIXED, 0x02, 0x03, 0x04, 0x05, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F}


def _past(raw: bytes, kind: int, at: int, end: int) -> int:
    """Where the value of a type that starts at `at` ends; ValueError if it does not end before `end`."""
    size = _FIXED.get(kind)
    if size is None:
        if kind == 0x0B:  # a pattern and its options, both ended by a zero
            return raw.index(0, raw.index(0, at, end) + 1, end) + 1
        if at + 4 > end:
            raise ValueError("value without room for its length")
        (n,) = struct.unpack_from("<i", raw, at)
        if kind in (0x02, 0x0D, 0x0E, 0x0C):
            size = 4 + n + (12 if kind == 0x0C else 0)
            if n < 1 or at + 4 + n > end or raw[at + 3 + n]:
                raise ValueError("string without its end")
        elif kind in (0x03, 0x04, 0x0F):
            size = n
            if n < 5:
                raise ValueError("document without its end")
        elif kind == 0x05:
            size = 5 + n
            if n < 0:
                raise ValueError("negative length")
        else:
            raise ValueError(f"BSON type {kind:#x}")
    if at + size > end:
        raise ValueError("value beyond its document")
    return at + size


def whole(raw: bytes, at: int, end: int | None = None) -> int:
    """The end of the document that starts at `at`, whose lengths, types and terminators all fit; ValueError if they do not, and IndexError if `raw` ends before it does."""
    end = len(raw) if end is None else end
    if at + 4 > end:
        raise IndexError(at)
    (n,) = struct.unpack_from("<i", raw, at)
    if n < 5:
        raise ValueError("length")
    if at + n > end:
        raise IndexError(at + n)
    stop = at + n - 1
    if raw[stop]:
        raise ValueError("no terminator")
    at += 4
    while at < stop:
        kind, name = raw[at], raw.index(0, at + 1, stop)
        at = _past(raw, kind, name + 1, stop)
        if kind in (0x03, 0x04):
            inner = at - struct.unpack_from("<i", raw, name + 1)[0]
            if whole(raw, inner, at) != at:
                raise ValueError("nested length")
    return stop + 1


def decode(raw: bytes, at: int = 0, as_list: bool = False, wanted: Collection[str] | None = None):
    """(value, end) of the document that starts at `at`; unknown types raise ValueError. With wanted, fields of other names are passed over undecoded."""
    (size,) = struct.unpack_from("<i", raw, at)
    end, at, out = at + size, at + 4, {}
    while at < end - 1:
        kind = raw[at]
        stop = raw.index(0, at + 1)
        name, at = raw[at + 1 : stop].decode(), stop + 1
        if wanted is not None and name not in wanted:
            at = _past(raw, kind, at, end)
            continue
        match kind:
            case 0x01:
                (value,), at = struct.unpack_from("<d", raw, at), at + 8
            case 0x02:
                (n,) = struct.unpack_from("<i", raw, at)
                value, at = raw[at + 4 : at + 3 + n].decode(), at + 4 + n
            case 0x03 | 0x04:
                value, at = decode(raw, at, kind == 0x04)
            case 0x05:
                (n,) = struct.unpack_from("<i", raw, at)
                value, at = raw[at + 5 : at + 5 + n], at + 5 + n
            case 0x07:
                value, at = raw[at : at + 12].hex(), at + 12
            case 0x08:
                value, at = raw[at] == 1, at + 1
            case 0x09:
                (ms,), at = struct.unpack_from("<q", raw, at), at + 8
                value = datetime.fromtimestamp(ms / 1000, UTC)
            case 0x0A:
                value = None
            case 0x10:
                (value,), at = struct.unpack_from("<i", raw, at), at + 4
            case 0x11 | 0x12:
                (value,), at = struct.unpack_from("<q", raw, at), at + 8
            case _:
                raise ValueError(f"BSON type {kind:#x} of {name}")
        out[name] = value
    return (list(out.values()) if as_list else out), end


def encode(doc: dict | list) -> bytes:
    """A document as BSON; for fixtures and exports."""
    body = b""
    for k, v in doc.items() if isinstance(doc, dict) else ((str(i), x) for i, x in enumerate(doc)):
        name = k.encode() + b"\0"
        match v:
            case None:
                body += b"\x0a" + name
            case bool():
                body += b"\x08" + name + bytes([v])
            case int():
                body += (b"\x10" + name + struct.pack("<i", v)) if -(2**31) <= v < 2**31 else (b"\x12" + name + struct.pack("<q", v))
            case float():
                body += b"\x01" + name + struct.pack("<d", v)
            case str():
                body += b"\x02" + name + struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0"
            case datetime():
                body += b"\x09" + name + struct.pack("<q", round(v.timestamp() * 1000))
            case dict():
                body += b"\x03" + name + encode(v)
            case list():
                body += b"\x04" + name + encode(v)
            case _:
                raise ValueError(f"no BSON for {type(v)}")
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def files(path: str) -> tuple[store.FileSystem, list[str]]:
    """The store and the paths in it that a path names, in order."""
    where, at = store.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (store.LocalFileSystem(), path)
    kind = where.get_file_info(at).type
    if kind == store.FileType.File:
        return where, [at]
    folder, pattern = (at, "*.bson") if kind == store.FileType.Directory else posixpath.split(at)
    listed = where.get_file_info(store.FileSelector(folder, allow_not_found=True))
    return where, sorted(f.path for f in listed if f.type == store.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def starts(where: store.FileSystem, path: str, chunk: int, limit: int | None) -> list[tuple[int, int]]:
    """(start, end) byte ranges of whole documents, about `chunk` bytes each; a bad length ends the list with its own range."""
    size = min(where.get_file_info(path).size, limit or 1 << 62)
    out, begin, at = [], 0, 0
    with where.open_input_file(path) as f:
        while at + 4 <= size:
            f.seek(at)
            (n,) = struct.unpack("<i", f.read(4))
            if n < 5 or at + n > size:
                break
            at += n
            if at - begin >= chunk:
                out.append((begin, at))
                begin = at
    return out + [(begin, size)] * (begin < size)


# ---------------------------------------------------------------- ranges that agree

#: Documents in a row that must fit where a range looks for its first one, and bytes that are looked at at once.
CHAIN, WINDOW = 3, 1 << 20
#: A document's size at most; what claims more is damaged.
LARGEST = 1 << 26


class _File:
    """A file's bytes by place, read in windows."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.held = f, size, 0, b""

    def bytes(self, at: int, n: int) -> tuple[bytes, int]:
        """(window, place of `at` in it) that holds n bytes from `at`, fewer at the end of the file."""
        if not (self.at <= at and min(at + n, self.size) <= self.at + len(self.held)):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(min(max(n, WINDOW), self.size - at))
        return self.held, at - self.at

    def byte(self, at: int) -> int:
        if self.at <= at < self.at + len(self.held):
            return self.held[at - self.at]
        self.f.seek(at)  # far away: the window stays
        return self.f.read(1)[0]

    def end_of(self, at: int) -> int:
        """The end of a whole document at `at`, or ValueError."""
        if at + 5 > self.size:
            raise ValueError("end of file")
        raw, i = self.bytes(at, 5)
        (n,) = struct.unpack_from("<i", raw, i)
        if not 5 <= n <= LARGEST or at + n > self.size or (raw[i + 4] not in _TYPES if n > 5 else raw[i + 4]):
            raise ValueError("length")
        if self.byte(at + n - 1):
            raise ValueError("no terminator")
        raw, i = self.bytes(at, n)
        return at + whole(raw, i, i + n) - i

    def length_at(self, at: int) -> int:
        """The end of a document at `at` by its length alone, or ValueError."""
        if at + 4 > self.size:
            raise ValueError("end of file")
        raw, i = self.bytes(at, 4)
        (n,) = struct.unpack_from("<i", raw, i)
        if n < 5 or at + n > self.size:
            raise ValueError("length")
        return at + n


def boundary(f: _File, at: int) -> int:
    """The first place from `at` on where CHAIN whole documents follow each other, or fewer up to the end of the file; the file's end if there is none."""
    while at + 5 <= f.size:
        end = at
        try:
            for _ in range(CHAIN):
                end = f.end_of(end)
                if end == f.size:
                    break
            return at
        except (ValueError, IndexError):
            at += 1
    return f.size


def _follow(f: _File, at: int, stop: int, resume: bool) -> tuple[list[tuple[int, int]], int, bool]:
    """(runs of documents, the first boundary from `stop` on, whether a bad length ended the file) along the lengths from `at` on."""
    runs, begin = [], at
    while at < stop:
        try:
            at = f.length_at(at)
        except ValueError:
            if begin < at:
                runs.append((begin, at))
            if not resume:
                return runs, f.size, True
            begin = at = boundary(f, at + 1)
    if begin < at and begin < stop:
        runs.append((begin, at))
    return runs, at, False


_PROBED = "path string, size long, k long, b long, start long, finish long, stopped boolean, runs array<struct<begin: long, stop: long>>"
_RUNS = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))


def split_dump(spark: SparkSession, path: str, table: str, chunk: int = 64 << 20, limit: int | None = None, resume: str = "") -> int:
    """Write the ranges (path, begin, stop) of whole documents of a dump as a Parquet table, for option `ranges`; returns how many ranges had found a wrong first document.

    Every range of `chunk` bytes is a row of a Spark job: it finds its first document and follows the lengths to the first one behind its end. Then one task for each file goes
    along its ranges, a narrow row each: what a range found holds if the one before ends there; where it does not (a value that holds documents itself, damage), the task follows that
    range from the right place. As a file's first range starts where the file does, all are right. The driver lists files and reads none of their data."""
    where, found = files(path)
    sizes = [(p, min(where.get_file_info(p).size, limit or 1 << 62)) for p in found]
    base = spark.createDataFrame(sizes, "path string, size long").where("size > 0")
    cut = base.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("size") - 1) / chunk).cast("long"))).alias("k"))
    ranges = sum(-(-n // chunk) for _, n in sizes)
    cut = cut.repartition(max(min(ranges, 2 * spark.sparkContext.defaultParallelism), sum(n for _, n in sizes) >> 26, 1))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, {"path": pa.string(), "stopped": pa.bool_(), "runs": _RUNS}.get(c, pa.int64())) for c in "path size k b start finish stopped runs".split()])
        for batch in batches:
            for row in batch.to_pylist():
                a, b = row["k"] * chunk, min((row["k"] + 1) * chunk, row["size"])
                with where.open_input_file(row["path"]) as raw:
                    f = _File(raw, row["size"])
                    start = boundary(f, a) if a else 0
                    runs, finish, stopped = _follow(f, start, b, bool(resume))
                out = row | {"b": b, "start": start, "finish": finish, "stopped": stopped, "runs": [{"begin": x, "stop": y} for x, y in runs]}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    def agree(rows: pa.Table) -> pa.Table:
        at, out, again = 0, [], 0
        for row in sorted(rows.to_pylist(), key=lambda r: r["k"]):
            if at >= row["b"]:
                continue  # within one document
            runs, finish, stopped, right = [(r["begin"], r["stop"]) for r in row["runs"]], row["finish"], row["stopped"], row["start"] == at
            if not right:
                with where.open_input_file(row["path"]) as raw:
                    runs, finish, stopped = _follow(_File(raw, row["size"]), at, row["b"], bool(resume))
            out += [(row["path"], x, y, right) for x, y in runs]
            at = finish
            if stopped:
                break
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("path", "begin", "stop", "right"), list(zip(*out, strict=True)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)})

    agreed = cut.mapInArrow(probe, _PROBED).groupBy("path").applyInArrow(agree, "path string, begin long, stop long, right boolean")
    agreed.write.parquet(table)
    return spark.read.parquet(table).where("not right").count()


class _Range(InputPartition):
    def __init__(self, where: store.FileSystem, path: str, begin: int, end: int):
        self.where, self.path, self.begin, self.end = where, path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.kinds = schema.names, [f.dataType.typeName() for f in schema]
        self.path, self.chunk, self.resume = options["path"], int(options.get("chunkbytes", 64 << 20)), options.get("resume", "")
        self.limit = int(options["maxbytes"]) if "maxbytes" in options else None
        self.ranges = options.get("ranges")
        self.conditions: list[tuple[int, str, object]] = []

    def partitions(self) -> list[_Range]:
        where, found = files(self.path)
        if self.ranges:
            in_, at = store.FileSystem.from_uri(self.ranges) if ":" in self.ranges else (store.LocalFileSystem(), self.ranges)
            rows = pq.read_table(at, filesystem=in_).to_pylist()
            return [_Range(where, r["path"], r["begin"], r["stop"]) for r in rows if r["path"] in set(found)]
        if self.resume == "chunk":
            return [_Range(where, p, 0, min(where.get_file_info(p).size, self.limit or 1 << 62)) for p in found]
        if self.resume == "next":
            raise ValueError("resume = next needs the ranges of split_dump()")
        return [_Range(where, p, a, b) for p in found for a, b in starts(where, p, self.chunk, self.limit)]

    def read(self, part: _Range | None) -> Iterator[tuple]:
        if part is None:  # what Spark reads where there is nothing to read
            return
        wanted = set(self.names)
        with part.where.open_input_file(part.path) as f:
            f.seek(part.begin)
            left, held = part.end - part.begin, b""
            while left > 0 or held:
                more = f.read(min(self.chunk, left))
                left -= len(more)
                held += more
                at = 0
                while at + 4 <= len(held):
                    (n,) = struct.unpack_from("<i", held, at)
                    if n < 5:
                        if self.resume != "chunk":
                            return
                        at = len(held)
                        break
                    if at + n > len(held):
                        break
                    doc, _ = decode(held, at, wanted=wanted)
                    row = tuple(self._typed(doc.get(k), t) for k, t in zip(self.names, self.kinds, strict=True))
                    if all(_meets(row[i], how, value) for i, how, value in self.conditions):
                        yield row
                    at += n
                held = held[at:]
                if not more:
                    return

    @staticmethod
    def _typed(value, kind: str):
        """A value in the schema's type, or null: numbers of either kind fit numeric columns, anything fits a string."""
        if value is None:
            return None
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if kind in ("long", "integer"):
            return int(value) if number and float(value).is_integer() else None
        if kind in ("double", "float"):
            return float(value) if number else None
        if kind == "decimal":
            return Decimal(str(value)) if number else None
        if kind == "string":
            return value if isinstance(value, str) else str(value)
        return value


_HOW = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "known", StringStartsWith: "starts"}
_COMPARED = {"long": int, "integer": int, "double": float, "string": str, "boolean": bool}


def _meets(x, how: str, value) -> bool:
    if x is None:
        return False
    match how:
        case "=":
            return x == value
        case "in":
            return x in value
        case ">":
            return x > value
        case ">=":
            return x >= value
        case "<":
            return x < value
        case "<=":
            return x <= value
        case "starts":
            return x.startswith(value)
    return True


class _Pushing(_Reader):
    """Takes conditions on fields whose type compares in Python as in Spark (not so: doubles that are no numbers)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            how, column = _HOW.get(type(f)), getattr(f, "attribute", ())
            kind = self.kinds[self.names.index(column[0])] if len(column) == 1 and column[0] in self.names else None
            value = getattr(f, "value", None)
            fits = _COMPARED.get(kind) is not None and (how == "known" or all(type(v) is _COMPARED[kind] and v == v for v in (value if how == "in" else [value])))
            if how and fits and not (kind == "double" and how in (">", ">=")):  # where NaN is the largest
                self.conditions.append((self.names.index(column[0]), how, set(value) if how == "in" else value))
            else:
                yield f


def write_dump(rows: DataFrame, folder: str) -> int:
    """Write rows as BSON documents into a folder, one file for each task that has any; returns their number. A repeated task replaces its file."""
    from pyspark import TaskContext

    where, at = store.FileSystem.from_uri(folder) if ":" in folder else (store.LocalFileSystem(), folder)
    where.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        name = f"{at}/part-{task.partitionId():06d}"
        with where.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
            for batch in batches:
                f.write(b"".join(map(encode, batch.to_pylist())))
                n += batch.num_rows
        if n:
            where.move(f"{name}.{task.taskAttemptId()}", f"{name}.bson")
        else:
            where.delete_file(f"{name}.{task.taskAttemptId()}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class BsonDump(DataSource):
    """Needs a schema: fields are picked by name, missing ones are null."""

    @classmethod
    def name(cls) -> str:
        return "bson_dump"

    def schema(self):
        raise ValueError("bson_dump needs a schema: fields are read by name")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class PushingBsonDump(BsonDump):
    """BsonDump that takes filters; Spark must be set to push them, as register() does."""

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pushing(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make bson_dump known to a session, with filters checked before rows are made."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PushingBsonDump)
