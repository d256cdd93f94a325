"""Token-id files in patched frame-of-reference blocks: block minimum, a percentile's width, exception lists, block index."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small
from .tokenize import encoder, with_end

BLOCK = 128
MAGIC = b"PFOR0001"
#: Ids after which a segment (one file's bytes) is closed.
SEGMENT_IDS = 1 << 20


def _width(x: np.ndarray) -> np.ndarray:
    """Bits of each number below 2^32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """ids (unsigned 32-bit) as one PFOR segment.

    Layout, little-endian: magic, ids (u64), blocks (u64), exceptions (u64); for each block its first word in the data (u32),
    its first exception (u32), minimum (u32) and width (u8); the data, 2 * width 64-bit words a block; then exceptions:
    places in their blocks (u8) and values above the minimum (u32). Each half of a block packs 64 numbers at its width,
    lowest bits first. An exception's low bits are packed with the others and ignored."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, np.uint32)
    x[:n] = ids
    x[n:] = ids[-1] if n else 0
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = x - least[:, None]
    rank = max(int(np.ceil(percentile * BLOCK)) - 1, 0)
    width = _width(np.partition(delta, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum(2 * width)]
    data = np.zeros(first[-1], np.uint64)
    for w in np.unique(width):
        if w == 0:
            continue
        of = np.flatnonzero(width == w)
        v = (delta[of].astype(np.uint64) & np.uint64((1 << int(w)) - 1)).reshape(-1, 64).T.copy()
        out = np.zeros((int(w), v.shape[1]), np.uint64)
        for j in range(64):
            word, shift = divmod(j * int(w), 64)
            out[word] |= v[j] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= v[j] >> np.uint64(64 - shift)
        data[(first[of][:, None] + np.arange(2 * w)).ravel()] = out.T.reshape(len(of), 2 * int(w)).ravel()
    b, at = np.nonzero(delta.astype(np.uint64) >> width.astype(np.uint64)[:, None])
    starts = np.searchsorted(b, np.arange(blocks))
    head = MAGIC + struct.pack("<QQQ", n, blocks, len(b))
    index = first[:-1].astype("<u4").tobytes() + starts.astype("<u4").tobytes() + least.astype("<u4").tobytes() + width.astype("u1").tobytes()
    return head + index + data.astype("<u8").tobytes() + at.astype("u1").tobytes() + delta[b, at].astype("<u4").tobytes()


def unpack(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last - 1 (all by default) of a segment; only these blocks' words are read."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PFOR segment")
    n, blocks, odd = struct.unpack_from("<QQQ", raw, 8)
    view = lambda kind, count, at: (np.frombuffer(raw, kind, count, at), at + count * np.dtype(kind).itemsize)
    word, at = view("<u4", blocks, 32)
    starts, at = view("<u4", blocks, at)
    least, at = view("<u4", blocks, at)
    width, at = view("u1", blocks, at)
    data, at = view("<u8", int(word[-1]) + 2 * int(width[-1]) if blocks else 0, at)
    places, at = view("u1", odd, at)
    values, at = view("<u4", odd, at)
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]):
        if w == 0:
            continue
        of = np.flatnonzero(width[first:last] == w) + first
        v = data[(word[of].astype(np.int64)[:, None] + np.arange(2 * int(w))).ravel()].reshape(-1, int(w)).T.copy()
        mask, got = np.uint64((1 << int(w)) - 1), np.empty((64, v.shape[1]), np.uint32)
        for j in range(64):
            k, shift = divmod(j * int(w), 64)
            x = v[k] >> np.uint64(shift)
            if shift + w > 64:
                x = x | (v[k + 1] << np.uint64(64 - shift))
            got[j] = x & mask
        out[of - first] = got.T.reshape(len(of), BLOCK)
    lo, hi = (int(starts[first]) if first < blocks else odd), (int(starts[last]) if last < blocks else odd)
    if hi > lo:
        block = np.repeat(np.arange(first, last), np.diff(np.r_[starts[first:last], hi]))
        out[block - first, places[lo:hi]] = values[lo:hi]
    out += least[first:last, None]
    return out.ravel()[: min(n, last * BLOCK) - first * BLOCK]


_SCHEMA = "part int, seq int, start long, n_docs int, n_ids long, doc_ids binary, counts binary, missing binary, payload binary"


def token_segments(docs: DataFrame, tokenizer: str, end_id: int = 2, keeps_space: bool = True, percentile: float = 0.9, text: str = "text", key: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Whole texts of docs as token ids, each followed by end_id, in files of PFOR blocks in ascending key order.

    One row is one file: part and seq order the files, start is the count of ids before it in its part, doc_ids (i64),
    counts (u32) and missing (u8: the key is null) describe its documents, payload is what pack() made. The table lies in
    the shared folder; keys sort ascending with null first, equal keys by their text. Null texts count as empty; an empty table
    gives no files; other columns are not read."""
    chosen = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = chosen.repartitionByRange("k").sortWithinPartitions("k", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, start = encoder(tokenizer, keeps_space), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, start, held
            ids, per, keys, none = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [part, seq, start, len(per), len(ids), keys.astype("<i8").tobytes(), per.astype("<u4").tobytes(), none.astype("u1").tobytes(), pack(ids, percentile)]
            seq, start, held = seq + 1, start + len(ids), []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            for piece in slices(batch, target=1 << 22):
                ids, per = with_end(*enc.encode(piece.column(1)), end_id)
                keys = piece.column(0)
                held.append((ids, per, keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)))
                if sum(len(h[0]) for h in held) >= segment_ids:
                    yield close()
        if held:
            yield close()

    return materialize(ordered.mapInArrow(write, _SCHEMA), "tokens")


def read_tokens(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from token_segments(): doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers) and, if asked for, those bytes as ids."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    before = materialize(before, "parts")  # a row for each task that wrote files
    named = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                per = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                raw, stop = memoryview(unpack(r["payload"]).astype("<u4").tobytes()), np.cumsum(per)
                begin = stop - per
                own = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                keys = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["missing"], "u1").astype(bool))
                out = [keys, pa.array(begin + r["base"] + r["start"]), pa.array(per), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array([bytes(x) for x in own], pa.binary())] * with_ids, names=[c for c, _ in named])

    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    chosen = segments.select("part", "start", "doc_ids", "counts", "missing", "payload").join(small(before), "part")
    return chosen.mapInArrow(read, ", ".join(f"{c} {kinds[t]}" for c, t in named))
