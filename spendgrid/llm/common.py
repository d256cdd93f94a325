"""Shared pieces: durable intermediate tables, size-checked broadcasts, components, and byte kernels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import shared_folder

# ---------------------------------------------------------------- tables that survive lost executors


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._spendgrid_path = path  # for discard()
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later result reads."""
    for t in tables:
        if path := getattr(t, "_spendgrid_path", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Rows of a narrow table (a few longs each) that may be broadcast; beyond it a shuffle join takes over.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if a count shows that it has at most `rows` rows; df must be materialized and narrow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_kept: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """What a Python worker keeps between tasks of one owner; tasks of any other owner make it forget, as workers outlive their stages."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def with_columns_of(docs: DataFrame, column: str, added: dict[str, DataType], judge: Callable[[pa.Array], list[pa.Array]], rows: int = 4096) -> DataFrame:
    """All rows and columns of docs, and the columns that judge makes of pieces of `column`; existing columns of these names are replaced.

    Columns pass the workers under numbers, so that their names may hold anything."""
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in {a.lower() for a in added}]
    names, at = [docs.columns[i] for i in kept], docs.columns.index(column)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(f"c{i}" for i in kept))
    schema = StructType([*(StructField(f"c{i}", docs.schema[i].dataType) for i in kept), *(StructField(c, t) for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, f"c{at}", rows=rows):
                yield pa.RecordBatch.from_arrays([*piece.columns, *judge(piece.column(kept.index(at)))], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, *added)


# ---------------------------------------------------------------- connected components


def spanning_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of one task's edges: at most one edge for each vertex leaves the task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    src, dst, root = flat[: len(a)], flat[len(a) :], np.arange(len(ids))
    while True:  # each vertex takes the smallest root of its neighbours, then roots are followed to their end
        low = np.minimum(root[src], root[dst])
        new = root.copy()
        np.minimum.at(new, root[src], low)
        np.minimum.at(new, root[dst], low)
        new = new[root]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    keep = np.flatnonzero(root != np.arange(len(ids)))
    for i in range(0, len(keep), 200_000):
        k = keep[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[root[k]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (a long, b long); component is the smallest id that links reach.

    Each task first reduces its edges to spanning stars; then smallest labels spread with pointer jumping
    until nothing changes. Every round is written to the shared folder. Empty edges give an empty table."""
    e = materialize(edges.select("a", "b").where("a != b").mapInArrow(spanning_stars, "a long, b long"), "edges")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        low = labels.join(heard, "id").select("id", "component", F.least("component", "heard").alias("low"))
        # what one member heard, all that share its label learn: whole components merge in a round
        shared = low.groupBy("component").agg(F.min("low").alias("shared"))
        step = materialize(low.join(shared, "component").select("id", "component", F.least("low", "shared").alias("new")), "labels")
        moved = step.where("new < component").limit(1).count()
        discard(labels)
        labels = step.select("id", F.col("new").alias("component"))
        labels._spendgrid_path = step._spendgrid_path
        if not moved:
            discard(e)
            return labels


# ---------------------------------------------------------------- byte kernels (numpy inside tasks)

_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]  # A-Z hash as a-z
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves the high and the low bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Polynomial prefix hashes modulo 2^64 of a byte buffer; of() gives the hash of any substrings."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = TABLE):
        up, self.down = _power(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", target: int = 1 << 19, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `target` bytes of text and at most `rows` rows; a longer text is a piece of its own."""
    _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + target, "right")) - 1, i + 1), i + rows, n)
        yield batch.slice(i, j - i)
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every run of bytes other than space and 0x09-0x0D."""
    solid = np.ones(len(buf) + 2, bool)
    solid[[0, -1]] = False
    solid[1:-1] = ~BLANK[buf]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = solid[1:-1][edge]  # a word never goes on into the next text
    last[edge - 1] = solid[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, token, size of each document's set) for the distinct word shingles of at most 4096 texts.

    A token is a 52-bit hash of `width` words with A-Z folded; a text of fewer words has its whole sequence as
    the one token, a text without words none. Tokens ascend within each document."""
    buf, off = text_buffer(col)
    n = len(off) - 1
    start, end, doc = words(buf, off)
    h = Rolling(buf, FOLDED).of(start, end) if len(start) else np.zeros(0, np.uint64)
    m = len(h) - width + 1
    keys = []
    if m > 0:
        t = h[:m].copy()
        for j in range(1, width):
            t = (t ^ (t >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : j + m]
        whole = doc[:m] == doc[width - 1 :]
        keys.append((doc[:m][whole], mix(t[whole])))
    count = np.bincount(doc, minlength=n)
    at = np.r_[0, np.cumsum(count)[:-1]] if n else np.zeros(0, int)
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            t = h[at[short]] + np.uint64(k)
            for j in range(1, k):
                t = (t ^ (t >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[at[short] + j]
            keys.append((short, mix(t ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    d, t = (np.concatenate(x) for x in zip(*keys, strict=True))
    packed = np.unique((d.astype(np.uint64) << np.uint64(52)) | (t >> np.uint64(12)))
    d = (packed >> np.uint64(52)).astype(np.int64)
    return d, (packed & np.uint64((1 << 52) - 1)).astype(np.int64), np.bincount(d, minlength=n)
