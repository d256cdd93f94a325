"""Repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

A suffix matters only through its first `width` bytes, its window, and two windows are equal exactly if they end in one group. Digits
are the bytes themselves: groups are split by 8 bytes after 8 bytes, and what is alone in its group leaves the sort at once.
1. Pass over anchors. The anchor of a window is the 16-byte string in it that a hash ranks least, so equal windows have equal
   anchors in the same place, and neighbouring suffixes share one (a run). The anchor's 16 bytes are the first two digits: only
   they travel, once for each string and unit (a batch of whole documents of about `unit` bytes). Suffixes whose anchor no other document holds leave.
2. Pass over windows. Each unit sorts its own open suffixes through all `width` bytes first; of equal ones only the
   first goes on, as a run with its bytes, to the task of its anchor, which sorts through all bytes again. Anchors of more than
   `hot` documents would gather one run for each document there: their suffixes are dealt singly, by all their bytes.
So whatever many documents share is one row for each unit in any group, and hashes choose tasks and anchors but never decide equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import materialize, mix, text_buffer, worker_memory

#: Bytes of an anchor: two digits.
ANCHOR = 16
#: Bytes of text in a unit; a longer text is a unit of its own.
UNIT = 4 << 20
#: Documents with one anchor beyond which its suffixes are dealt singly.
HOT = 16_384
#: Windows that are worked on at once: anchors of so many, and sorts of about twice that many at most.
STEP = 1 << 18
_CLOSED, _OPEN, _HOT = 0, 1, 2


# ---------------------------------------------------------------- kernels


def _words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The digit of 8 bytes, most significant first, at each of these places."""
    return np.ascontiguousarray(sliding_window_view(buf, 8)[at]).view(">u8")[:, 0].astype(np.uint64)


def equal_groups(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first): rows of `at` whose `width` bytes equal those of another row, group after group, and for each the group's first row.

    Rows of a group keep their order. A digit is looked at only in groups that are left, and only groups that it splits are sorted."""
    rows = np.zeros(0, np.int64)
    for depth in [*range(0, width - 8, 8), width - 8]:
        if depth == 0:
            word = _words(buf, at) if len(at) else np.zeros(0, np.uint64)
            rows = np.argsort(word, kind="stable")
            word = word[rows]
            new = np.ones(len(rows), bool)
            new[1:] = word[1:] != word[:-1]
        elif len(rows):
            word = _words(buf, at[rows] + depth)
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(rows)])
            split = np.repeat(np.logical_or.reduceat(word != np.repeat(word[start], size), start), size)
            some = np.flatnonzero(split)
            order = np.lexsort((word[some], np.cumsum(new)[some]))
            rows[some], word = rows[some][order], word[some][order]
            new[some[1:]] |= word[1:] != word[:-1]
        stay = ~(new & np.r_[new[1:], True])  # not alone
        rows, new = rows[stay], new[stay]
    return rows, np.repeat(rows[new], np.diff(np.r_[np.flatnonzero(new), len(rows)]))


def anchors(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's two digits) of every run of windows of documents in buf with one anchor."""
    n = max(len(buf) - width + 1, 0)
    whole = np.diff(off) >= width
    edge = np.zeros(n + 1, np.int32)  # windows that lie in one document
    np.add.at(edge, off[:-1][whole], 1)
    np.add.at(edge, off[1:][whole] - width + 1, -1)
    inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    head = np.zeros(n + 1, bool)
    head[off[:-1][whole]] = True
    parts = []
    for s in range(0, n, STEP):
        m = min(STEP, n - s)
        x = buf[s : s + m + width - 1].astype(np.uint64)
        for k in (1, 2, 4):  # 8 bytes at every place
            x = (x[:-k] << np.uint64(8 * k)) | x[k:]
        high, low = x[:-8], x[8:]
        rank = mix(high * np.uint64(0x9FB21C651E98DF25) ^ (low ^ (low >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))
        rank = (rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=np.uint64)
        span, reach = width - ANCHOR + 1, 1
        while 2 * reach <= span:
            rank, reach = np.minimum(rank[:-reach], rank[reach:]), 2 * reach
        if reach < span:
            rank = np.minimum(rank[: len(rank) - (span - reach)], rank[span - reach :])
        at = (rank & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok, new = inside[s : s + m], head[s : s + m].copy()
        new[0] = True
        new[1:] |= (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        stop = np.flatnonzero(ok & np.r_[(new | ~ok)[1:], True]) + 1
        parts.append((first + s, stop - first, high[at[first]], low[at[first]]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (many of them) of each run, one after another."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _joined(place: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, length) of the stretches in which place and all others go up by one."""
    new = np.ones(len(place), bool)
    if len(place):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] + 1 for x in (place, *others)])
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(place)])


def _packed(*columns: tuple[np.ndarray, int], tail: bytes = b"") -> bytes:
    """Columns of whole numbers with these numbers of bytes, compressed, and raw bytes behind them."""
    head = np.array([len(c) for c, _ in columns], "<u4").tobytes()
    body = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes() for c, size in columns)
    return zstandard.compress(head + body + tail, 1)


def _unpacked(raw: bytes, *sizes: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.decompress(raw)
    count, at, out = np.frombuffer(raw, "<u4", len(sizes)), 4 * len(sizes), []
    for n, size in zip(count.tolist(), sizes, strict=True):
        x = np.zeros((n, 8), np.uint8)
        x[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(x.view("<u8")[:, 0].astype(np.uint64))
        at += n * size
    return out, np.frombuffer(raw, np.uint8, offset=at)


class _Unit:
    """A unit's open part: documents with a key, their anchors, and the unit's distinct anchors in the order of their messages."""

    def __init__(self, body: bytes, text: int, width: int, tasks: int):
        batch = pa.ipc.open_stream(body).read_all().combine_chunks()
        self.batch = batch
        self.buf, self.off = text_buffer(batch.column(text))
        keys = batch.column(batch.num_columns - 1).combine_chunks()
        self.known = keys.is_valid().to_numpy(zero_copy_only=False)
        self.keys = keys.fill_null(0).to_numpy()
        self.width, self.tasks = width, tasks

    def find(self) -> None:
        start, many, high, low = anchors(self.buf, self.off, self.width)
        row = np.searchsorted(self.off, start, "right") - 1
        keep = self.known[row]
        start, many, high, low, row = (x[keep] for x in (start, many, high, low, row))
        to = (mix(high ^ mix(low.copy())) % np.uint64(self.tasks)).astype(np.int64)
        key = self.keys[row]
        order = np.lexsort((start, key, low, high, to))
        self.start, self.many, self.key, high, low, to = (x[order] for x in (start, many, key, high, low, to))
        new = np.ones(len(to), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.high, self.low, self.to = high[self.first], low[self.first], to[self.first]

    def documents(self) -> np.ndarray:
        """How many documents hold each distinct anchor."""
        new = np.ones(len(self.key), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.group[1:] != self.group[:-1])
        return np.bincount(self.group[new], minlength=len(self.first))

    def own_sort(self, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the open windows, by state of each distinct anchor: (windows that go on, their anchors, covered windows, echoes, what these echo).

        A window is covered if a document of the unit with a smaller key has it, an echo if its own document has it before."""
        runs = np.flatnonzero(state[self.group] > _CLOSED)
        _, last = _edges(self.group[runs])
        chunk = np.cumsum(self.many[runs])[last - 1] // STEP  # whole anchors, about that many windows at once
        ends = last[np.flatnonzero(np.r_[chunk[1:] != chunk[:-1], True])] if len(runs) else last
        going, of, covered, echo, source = [], [], [], [], []
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=len(ends) > 0):
            some = runs[a:b]
            place, owner = _spread(self.start[some], self.many[some]), np.repeat(some, self.many[some])
            rows, first = equal_groups(self.buf, place, self.width)
            later = rows != first
            rows, first = rows[later], first[later]
            stay = np.ones(len(place), bool)
            stay[rows] = False
            behind = self.key[owner[rows]] > self.key[owner[first]]
            going.append(place[stay]), of.append(self.group[owner[stay]])
            covered.append(place[rows[behind]]), echo.append(place[rows[~behind]]), source.append(place[first[~behind]])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (going, of, covered, echo, source))


def _rows(names: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    named = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _edges(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, one past the last) of the stretches of equal numbers."""
    if not len(to):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return first, np.r_[first[1:], len(to)]


_MESSAGE = "to long, unit long, message binary"


# ---------------------------------------------------------------- the passes


def units_of(docs: DataFrame, text: str, unit: int) -> DataFrame:
    """A table (unit, n, body): docs in batches of about `unit` bytes of text, as compressed Arrow streams."""
    at = docs.columns.index(text)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("suffixes")
        made, kept, size = TaskContext.get().partitionId() << 32, [], 0

        def body() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(kept).combine_chunks())
            return _rows("unit long, n long, body binary", [made], [size], [sink.getvalue().to_pybytes()])

        for batch in batches:
            _, off = text_buffer(batch.column(at))
            i = 0
            while i < batch.num_rows:
                j = min(max(int(np.searchsorted(off, off[i] + unit - size, "right")) - 1, i + (not kept)), batch.num_rows)
                if j > i:
                    kept.append(batch.slice(i, j - i))
                    size += int(off[j] - off[i])
                if j < batch.num_rows or size >= unit:
                    yield body()
                    made, kept, size = made + 1, [], 0
                i = j
        if kept:
            yield body()

    return materialize(docs.mapInArrow(gather, "unit long, n long, body binary"), "units", compression="uncompressed")


def _answers(units: DataFrame, answers: DataFrame) -> DataFrame:
    """Each unit with the answers to its messages."""
    return units.join(answers.groupBy("unit").agg(F.collect_list(F.struct("to", "message")).alias("answers")), "unit", "left").select("unit", "body", "answers")


def _read_answers(cell: pa.Scalar) -> dict[int, bytes]:
    return {a["to"]: a["message"] for a in cell.as_py() or []}


def window_messages(units: DataFrame, text: int, width: int, hot: int) -> DataFrame:
    """(to, unit, message): each unit's open windows for the tasks that settle them, and, to -1 - unit, what it tells itself.

    text: the place of the text among the columns of the units' rows, whose last column is the key."""
    spark = units.sparkSession
    size = units.agg(F.sum("n")).first()[0] or 0
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 22)  # about 4 MB of text each

    def deal_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u = _Unit(body.as_buffer(), text, width, tasks)
                u.find()
                many = u.documents()
                a, b = _edges(u.to)
                sent = [_packed((u.high[i:j], 8), (u.low[i:j], 8), (many[i:j], 4)) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                yield _rows(_MESSAGE, u.to[a], [unit] * len(sent), sent)

    def settle_anchors(table: pa.Table) -> pa.Table:
        got = [_unpacked(m.as_py(), 8, 8, 4)[0] for m in table.column("message")]
        high, low, many = (np.concatenate(x) for x in zip(*got, strict=True))
        raw = np.stack([high, low], axis=1).astype(">u8").view(np.uint8).ravel()
        rows, first = equal_groups(raw, ANCHOR * np.arange(len(high)), ANCHOR)
        total = many.astype(np.int64)
        sums = np.bincount(first, many[rows].astype(np.float64), minlength=len(high))
        total[rows] = sums[first].astype(np.int64)
        state = np.where(total > hot, _HOT, np.where(total > 1, _OPEN, _CLOSED)).astype(np.uint8)
        ends = np.cumsum([len(g[0]) for g in got])
        said = [zstandard.compress(s.tobytes(), 1) for s in np.split(state, ends[:-1])]
        return pa.table({"to": table.column("to"), "unit": table.column("unit"), "message": pa.array(said, pa.binary())})

    first_pass = units.select("unit", "body").mapInArrow(deal_anchors, _MESSAGE).groupBy("to").applyInArrow(settle_anchors, _MESSAGE)

    def deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, body, cell in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                answers = _read_answers(cell)
                if not answers:
                    continue
                u = _Unit(body.as_buffer(), text, width, tasks)
                u.find()
                state = np.frombuffer(b"".join(zstandard.decompress(answers[t]) for t in sorted(answers)), np.uint8)
                going, of, covered, echo, source = u.own_sort(state)
                # stretches of one anchor go on whole, windows of hot anchors singly
                new = np.ones(len(going), bool)
                new[1:] = (going[1:] != going[:-1] + 1) | (of[1:] != of[:-1]) | (state[of[1:]] == _HOT)
                first = np.flatnonzero(new)
                many, run_of = np.diff(np.r_[first, len(going)]), of[first]
                start = going[first]
                to = u.to[run_of]
                lone = np.flatnonzero(state[run_of] == _HOT)
                if len(lone):
                    spread = np.zeros(len(lone), np.uint64)
                    for depth in [*range(0, width - 8, 8), width - 8]:
                        spread = mix(spread * np.uint64(0x9E3779B97F4A7C15) + _words(u.buf, start[lone] + depth))
                    to[lone] = (spread % np.uint64(tasks)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, start, many = to[order], start[order], many[order]
                key = u.keys[np.searchsorted(u.off, start, "right") - 1]
                a, b = _edges(to)
                sent = []
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    sent.append(_packed((key[i:j].view(np.uint64), 8), (many[i:j], 4), tail=u.buf[_spread(start[i:j], many[i:j] + width - 1)].tobytes()))
                f, n = _joined(np.sort(covered))
                e, k = _joined(echo, source)
                own = _packed((np.sort(covered)[f], 4), (n, 4), (echo[e], 4), (source[e], 4), (k, 4), (start, 4), (many, 4), (b - a, 4))
                yield _rows(_MESSAGE, [*to[a].tolist(), -1 - unit], [unit] * (len(sent) + 1), [*sent, own])

    return _answers(units, first_pass).mapInArrow(deal_windows, _MESSAGE)


def covered_windows(units: DataFrame, text: int, width: int, hot: int) -> DataFrame:
    """(to, unit, message): what each unit needs to tell which of its windows documents with smaller keys hold."""
    most = 2 * STEP  # sent with the task

    def settle_windows(table: pa.Table) -> pa.Table:
        if table.column("to")[0].as_py() < 0:  # what a unit tells itself
            return table
        keys, manys, bodies = [], [], []
        for m in table.column("message"):
            (key, many), tail = _unpacked(m.as_py(), 8, 4)
            keys.append(key.view(np.int64)), manys.append(many.astype(np.int64)), bodies.append(tail)
        key, many, buf = np.concatenate(keys), np.concatenate(manys), np.concatenate(bodies)
        start = np.cumsum(many + width - 1) - (many + width - 1)
        order = np.argsort(key, kind="stable")  # so that a group's first row has its smallest key
        place, of = _spread(start[order], many[order]).astype(np.int32), np.repeat(order, many[order]).astype(np.int32)
        # a large task sorts in several parts, dealt by the first digit
        parts = 1 + len(place) // most
        part = np.concatenate([(mix(_words(buf, place[i : i + STEP])) % np.uint64(parts)).astype(np.int16) for i in range(0, len(place), STEP)]) if parts > 1 else np.zeros(len(place), np.int8)
        found = []
        for k in range(parts):
            some = np.flatnonzero(part == k)
            rows, first = (some[x] for x in equal_groups(buf, place[some], width))
            found.append(rows[key[of[rows]] > key[of[first]]])
        taken = np.concatenate(found)
        bits = np.zeros(int(many.sum()), bool)
        bits[(np.cumsum(many) - many)[of[taken]] + place[taken] - start[of[taken]]] = True
        ends = np.cumsum([int(m.sum()) for m in manys])
        said = [zstandard.compress(np.packbits(x).tobytes(), 1) for x in np.split(bits, ends[:-1])]
        return pa.table({"to": table.column("to"), "unit": table.column("unit"), "message": pa.array(said, pa.binary())})

    return window_messages(units, text, width, hot).groupBy("to").applyInArrow(settle_windows, _MESSAGE)


def _removed(answers: dict[int, bytes], n: int, width: int) -> np.ndarray:
    """Which of a unit's n bytes go."""
    edge = np.zeros(n + 1, np.int32)
    own = next((m for t, m in answers.items() if t < 0), None)
    if own is None:
        return edge[:n].astype(bool)
    at, size, echo, source, k, start, many, runs = (x.astype(np.int64) for x in _unpacked(own, *[4] * 8)[0])
    taken = np.zeros(n, bool)
    done = 0
    for t, r in zip(sorted(t for t in answers if t >= 0), runs.tolist(), strict=True):
        place = _spread(start[done : done + r], many[done : done + r])
        taken[place] = np.unpackbits(np.frombuffer(zstandard.decompress(answers[t]), np.uint8), count=len(place)).astype(bool)
        done += r
    taken[_spread(echo, k)] |= taken[_spread(source, k)]
    taken[_spread(at, size)] = True
    place = np.flatnonzero(taken)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + width, -1)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, width: int = 50, text: str = "text", key: str = "doc_id", unit: int = UNIT, hot: int = HOT) -> DataFrame:
    """All rows of docs with kept (binary: the bytes of the text that are left), n_bytes, n_removed, n_spans and spans
    (array of start and end of the maximal removed runs).

    A byte goes if a `width`-byte string (24 or more) that covers it also starts in a document with a smaller key; strings are
    judged on the input, matches never cross documents, null texts count as empty. Rows with a null key keep all their
    bytes and take none from others. Rows with one key never take from each other. Repeated rows are each
    judged. A very long text is a unit of its own: a task holds it whole (a few bytes for each of its bytes), but sorts it in steps. An empty table gives an empty
    result; existing columns of these names are replaced."""
    if width < 24:
        raise ValueError("strings of fewer than 24 bytes are not supported")
    names = ["kept", "n_bytes", "n_removed", "n_spans", "spans"]
    given = docs.columns
    left = [i for i, c in enumerate(given) if c.lower() not in names]
    # columns pass the workers under numbers, so that their names may hold anything
    docs = docs.toDF(*(f"c{i}" for i in range(len(given)))).select(*(f"c{i}" for i in left))
    at = left.index(given.index(text))
    units = units_of(docs.withColumn("_id", F.col(f"c{given.index(key)}").cast("long")), docs.columns[at], unit)
    answers = covered_windows(units, at, width, hot)
    columns = [*docs.columns, *names]
    spans = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType([*docs.schema.fields, *(StructField(c, t) for c, t in zip(names, (BinaryType(), LongType(), LongType(), LongType(), spans), strict=True))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, cell in zip(batch.column(1), batch.column(2), strict=True):
                u = _Unit(body.as_buffer(), at, width, 1)
                buf, off = u.buf, u.off
                gone = _removed(_read_answers(cell), len(buf), width)
                raw = buf[~gone].tobytes()
                stay = np.r_[0, np.cumsum(~gone)][off]
                head = np.zeros(len(buf) + 1, bool)
                head[off] = True
                open_ = np.flatnonzero(gone & (~np.r_[False, gone[:-1]] | head[:-1]))
                close = np.flatnonzero(gone & (~np.r_[gone[1:], False] | head[1:])) + 1
                doc = np.searchsorted(off, open_, "right") - 1
                spans = np.bincount(doc, minlength=len(off) - 1)
                pairs = pa.StructArray.from_arrays([pa.array((open_ - off[doc]).astype(np.int32)), pa.array((close - off[doc]).astype(np.int32))], names=["start", "end"])
                size = np.diff(off)
                out = [pa.array([raw[a:b] for a, b in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)], pa.binary()), pa.array(size), pa.array(size - np.diff(stay)), pa.array(spans.astype(np.int64))]
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(spans)].astype(np.int32)), pairs))
                for part in pa.Table.from_arrays([*u.batch.columns[:-1], *out], names=columns).combine_chunks().to_batches(max_chunksize=1024):
                    yield part

    return _answers(units, answers).mapInArrow(cut, schema).toDF(*(given[i] for i in left), *names)
