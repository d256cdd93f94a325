"""Best-fit packing by length-histogram planning: best-fit over counts, then pieces take slots by rank within length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokenize import encoder, with_end


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts of lengths of at most capacity; rows (length, first rank, n, first sequence, offset, stack).

    The n pieces of that length from the first rank on go, stack by stack, to the sequences from the first one on, from this offset on.
    Open sequences are kept as runs by the room left in them: the fullest one that a piece fits takes as many as its room holds before
    the next one is looked at, as pieces one by one would. A step uses up a run or a length, so the work and the
    plan depend on the capacity and not on how many pieces there are."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, n) of runs
    rooms: list[int] = []  # ascending
    rows, opened = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            stack = room // length
            full, more = min(n, left // stack), 0
            if full < n:
                more = left - full * stack  # a last sequence takes what is left
            for begin, many, each in ((first, full, stack), (first + full, 1, more)):
                if many * each:
                    rows.append((length, rank, many * each, begin, capacity - room, each))
                    rank += many * each
                    keep(room - each * length, begin, many)
            left -= full * stack + more
            used = full + (more > 0)
            keep(room, first + used, n - used)
    return np.array(rows, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keeps_space: bool, text: str, key: str, with_ids: bool) -> DataFrame:
    """A table of docs' pieces with their task and their rank among the task's pieces of the same length."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, target=1 << 22):
                ids, per = with_end(*enc.encode(part.column(1)), end_id)
                many = -(-per // capacity)
                doc = np.repeat(np.arange(len(per)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(per[doc] - piece * capacity, capacity)
                begin = np.repeat(np.cumsum(per) - per, many) + piece * capacity
                raw = memoryview(ids.astype("<u4").tobytes())
                own = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                in_order = length[order]
                run = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]]) if len(order) else np.zeros(0, int)
                size = np.diff(np.r_[run, len(order)])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(run, size) + seen[in_order]
                seen[in_order[run]] += size
                out = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int32())]
                out += [pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)]
                out += [pa.array([bytes(x) for x in own], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialize(chosen.mapInArrow(cut, schema), "pieces", compression="zstd")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keeps_space: bool = False, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` token ids, packed best-fit: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    and, with_ids, the ids as little-endian unsigned 32-bit integers.

    A document is its text's ids and end_id; only one longer than the capacity is cut, its last piece may be shorter.
    The driver sees one count for each length. Null texts count as empty (a piece of one token); rows with a null key and repeated rows are
    packed each; a very long text is encoded whole by its task and becomes many pieces; an empty table gives an empty result; other columns are not read."""
    table = pieces(docs, tokenizer, capacity, end_id, keeps_space, text, key, with_ids)
    groups = materialize(table.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = totals.pop(capacity, 0)
    plan = plan_slots(totals, capacity)
    # length and rank in one number: a slot's run is found by bisection
    starts = (plan[:, 0] << 48) | plan[:, 1]
    order = np.argsort(starts)
    shared = docs.sparkSession.sparkContext.broadcast((starts[order], plan[order]))  # its size follows from the capacity

    # tasks times lengths rows: broadcast only if Spark finds them small
    before = groups.select("task", "length", F.expr("coalesce(sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    placed = table.join(materialize(before, "ranks"), ["task", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, rows = shared.value
        length, rank = length.to_numpy().astype(np.int64), rank.to_numpy()
        if len(key) == 0:
            return pd.DataFrame({"sequence_id": rank, "offset": np.zeros_like(rank)})
        row = rows[np.maximum(np.searchsorted(key, (length << 48) | rank, "right") - 1, 0)]
        whole = length == capacity
        among, level = np.divmod(rank - row[:, 1], row[:, 5])
        return pd.DataFrame({"sequence_id": np.where(whole, rank, full + row[:, 3] + among), "offset": np.where(whole, 0, row[:, 4] + level * length)})

    named = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *["ids"] * with_ids]
    return placed.select(*named, slot("length", F.col("rank") + F.col("before")).alias("s")).select("*", "s.sequence_id", "s.offset").drop("s")
