"""Grouping of spelling variants: words of a corpus that one inserted, deleted or replaced character turns into each other, found with minimal acyclic
automata. The sorted lexicon is dealt into shards; a shard's forward automaton holds its words, another lexicon of reversed words has backward ones. A word
matches its first half exactly in forward automata and its second half exactly in backward ones, and each completes the other half with one error; what both find counts
once. Words bear the numbers that the automaton itself gives them (a minimal perfect hash), by which their counts are kept."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TABLE, Rolling, discard, materialize, slices, small, text_buffer, words

#: Words of a shard, on average; a task holds one automaton of such size at a time.
SHARD_WORDS = 1 << 15
#: Different words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Beyond every character of words (which end at U+00FF).
_BEYOND = "Ā"
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- the automaton


class Automaton:
    """The minimal acyclic automaton of ascending different words, with their numbers (0, 1, ... in that order).

    A state's edges are {character: (state, words before)}: words of the state that come before those which the edge leads to, itself included where the state
    ends a word. Equal states are one, so that all words share their endings."""

    def __init__(self, ascending: Iterator[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[str, list]] = []  # open states of the last word: (character into it, [final, {character: state}])
        root: list = [False, {}]
        last = ""
        for word in ascending:
            same = 0
            while same < len(path) and same < len(word) and path[same][0] == word[same]:
                same += 1
            self._close(root, path, same)
            for c in word[same:]:
                path.append((c, [False, {}]))
            (path[-1][1] if path else root)[0] = True
            last = word
        self._close(root, path, 0)
        self.root = self._state(root)
        self.last = last
        del self._known

    def _close(self, root: list, path: list[tuple[str, list]], keep: int) -> None:
        while len(path) > keep:
            c, state = path.pop()
            (path[-1][1] if path else root)[1][c] = self._state(state)

    def _state(self, state: list) -> int:
        key = (state[0], *state[1].items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.edges)
            before, edges = int(state[0]), {}
            for c, target in state[1].items():
                edges[c] = (target, before)
                before += self.size[target]
            self.edges.append(edges)
            self.final.append(state[0])
            self.size.append(before)
        return found

    def walk(self, text: str, state: int | None = None, number: int = 0) -> tuple[int, int] | None:
        """(state, words before) behind text, or None if no word goes on like this."""
        s = self.root if state is None else state
        edges = self.edges
        for c in text:
            step = edges[s].get(c)
            if step is None:
                return None
            s = step[0]
            number += step[1]
        return s, number

    def number(self, word: str) -> int | None:
        found = self.walk(word)
        return found[1] if found and self.final[found[0]] else None

    def word(self, number: int) -> str:
        s, out = self.root, []
        while number or not self.final[s]:
            c, (target, before) = max((e for e in self.edges[s].items() if e[1][1] <= number), key=lambda e: e[1][1])
            s, number = target, number - before
            out.append(c)
        return "".join(out)

    def one_error(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that are exact + rest with one insertion, deletion or replacement in rest."""
        found: set[int] = set()
        at = self.walk(exact)
        if at is None:
            return found
        s, number = at
        edges, final = self.edges, self.final
        for i in range(len(rest) + 1):
            tail = rest[i + 1 :]
            here = rest[i] if i < len(rest) else ""
            if here:  # without this character
                end = self.walk(tail, s, number)
                if end and final[end[0]]:
                    found.add(end[1])
            for c, (target, before) in edges[s].items():
                if here and c != here:  # another one in its place
                    step = edges[target].get(tail[0]) if tail else None
                    if not tail or step:
                        end = self.walk(tail, target, number + before)
                        if end and final[end[0]]:
                            found.add(end[1])
                if not here or here in edges[target]:  # one more before it
                    end = self.walk(rest[i:], target, number + before)
                    if end and final[end[0]]:
                        found.add(end[1])
            if here:
                step = edges[s].get(here)
                if step is None:
                    break
                s, number = step[0], number + step[1]
        return found


# ---------------------------------------------------------------- words and their counts

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Bytes up to which checksums are joined by their linearity; longer words are read again.
_JOINED = 64


def _checksums(prefix: list[bytes], doc: np.ndarray, word: np.ndarray, names: list[bytes]) -> np.ndarray:
    """crc32 of prefix[doc] + names[word] of each pair: the checksum is linear, so a document's part is carried over as many bytes as the word has, and the
    word's own part is added."""
    state = np.array([zlib.crc32(p) ^ 0xFFFFFFFF for p in prefix], np.uint32)
    own = np.array([zlib.crc32(w, 0xFFFFFFFF) ^ 0xFFFFFFFF for w in names], np.uint32)
    size = np.array([len(w) for w in names], np.int64)
    carried = np.zeros((int(min(size.max(initial=0), _JOINED)) + 1, len(prefix)), np.uint32)
    carried[0] = state
    for k in range(1, len(carried)):
        carried[k] = _CRC[carried[k - 1] & np.uint32(255)] ^ (carried[k - 1] >> np.uint32(8))
    far = size[word] > _JOINED
    out = carried[np.where(far, 0, size[word]), doc] ^ own[word] ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(far):
        out[i] = zlib.crc32(prefix[doc[i]] + names[word[i]])
    return out


def _runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document index, word, occurrences) of the words in each text, ascending, and the words' UTF-8: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased."""
    buf, off = text_buffer(col)
    lead = buf == 0xC3  # in UTF-8 the first of the two bytes of each of these characters, and of no other
    letter = _ALPHA[buf] | lead
    letter[1:] |= lead[:-1]
    low = np.where(letter, _LOWER[buf], 32).astype(np.uint8)
    start, end, doc = words(low, off)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + ([],)
    _, first, word = np.unique(Rolling(low, TABLE).of(start, end), return_index=True, return_inverse=True)
    raw = low.tobytes()
    names = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    pair, times = np.unique(doc * len(names) + word, return_counts=True)
    return pair // len(names), pair % len(names), times, names


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = 199, length: int = 6) -> DataFrame:
    """(word, n) of the words of at least `length` characters in all whole texts, with planted slips: where `slip` divides h, the crc32 of '<key>:<word>', the
    word's character h % length is left out (slip 0: nowhere). Null texts hold no word, a null key reads as an empty one; rows of one key count each."""
    plain = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return done

        for batch in batches:
            for piece in slices(batch):
                doc, word, times, names = _runs(piece.column(1))
                if not names:
                    continue
                if slip:
                    h = _checksums([f"{k or ''}:".encode() for k in piece.column(0).to_pylist()], doc, word, names)
                    slipped = np.flatnonzero(h % np.uint32(slip) == 0)
                    for i in slipped:
                        w = names[word[i]].decode()
                        j = int(h[i]) % len(w)
                        if len(w) > length:
                            w = (w[:j] + w[j + 1 :]).encode()
                            held[w] = held.get(w, 0) + int(times[i])
                    times[slipped] = 0
                total = np.bincount(word, times, minlength=len(names)).astype(np.int64)
                for w, n in zip(names, total.tolist(), strict=True):
                    if n and len(w) - w.count(0xC3) >= length:
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- near words


def _half(word: str) -> int:
    return len(word) // 2


def _near(lexicon: DataFrame, size: int, backward: bool) -> DataFrame:
    """(word, n, n_near, best_n, best): for each word and shard that it was looked up in, how many near words this direction finds there, and the one of the
    largest count. Forward: near words that begin with the word's first half; backward: the others that end with its second half."""
    spark = lexicon.sparkSession
    form: Column = F.reverse("word") if backward else F.col("word")
    shards = max(1, -(-size // SHARD_WORDS))
    dealt = lexicon.select(form.alias("word"), "n").repartitionByRange(shards, "word").withColumn("shard", F.spark_partition_id().cast("long"))
    dealt = materialize(dealt, "shards")
    ends = sorted(tuple(r) for r in dealt.groupBy("shard").agg(F.min("word").alias("a"), F.max("word").alias("b")).select("a", "b", "shard").collect())  # a row for each SHARD_WORDS words
    bounds = spark.sparkContext.broadcast(([a for a, _, _ in ends], [b for _, b, _ in ends], [s for *_, s in ends]))
    count = max((s for *_, s in ends), default=0) + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word once for each shard that may hold words which share its half; most have one."""
        low, high, number = bounds.value
        for batch in batches:
            at, to = [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                half = w[: len(w) - _half(w)] if backward else w[: _half(w)]
                a, b = bisect_left(high, half), bisect_right(low, half + _BEYOND)
                at += [i] * (b - a)
                to += number[a:b]
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([1] * len(to), pa.int32()), rows.column(0), rows.column(1)], names=["shard", "kind", "word", "n"])

    asked = dealt.select("word", "n").mapInArrow(ask, "shard long, kind int, word string, n long")
    both = dealt.select("shard", F.lit(0).alias("kind"), "word", "n").unionByName(asked)
    met = both.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind", "word")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard come together, its words first: they make the automaton, the others ask it."""
        of, held, numbers, automaton = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for shard, kind, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != of:
                    of, held, numbers, automaton = shard, [], [], None
                if kind == 0:
                    held.append(w)
                    numbers.append(n)
                    continue
                if automaton is None:
                    automaton, held = Automaton(iter(held)), []
                cut = len(w) - _half(w) if backward else _half(w)
                near, most, best = 0, 0, None
                own = w[::-1][: _half(w)] if backward else None
                for j in automaton.one_error(w[:cut], w[cut:]):
                    y = automaton.word(j)
                    if backward:
                        y = y[::-1]
                        if y.startswith(own):
                            continue  # the forward look-up finds it
                    near += 1
                    if numbers[j] > most or (numbers[j] == most and y < best):
                        most, best = numbers[j], y
                out.append((w[::-1] if backward else w, n, near, most or None, best))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["word", "n", "n_near", "best_n", "best"])

    return met.mapInArrow(answer, "word string, n long, n_near long, best_n long, best string")


def spelling_groups(counts: DataFrame, least: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of counts (word, n; words of characters up to U+00FF) with n >= least.

    Two words are near if one inserted, deleted or replaced character turns one into the other; n_near counts a word's near words. Its form is its near word of the
    largest n (ties: the smallest in code-point order) if that n is at least `ratio` (2 or more) times its own, else null; form_n is the form's n. root follows forms to the last; a word
    without a form is its own root. Words must be distinct; null words are left out; an empty table gives an empty one."""
    lexicon = materialize(counts.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("word", "n"), "lexicon")
    size = lexicon.count()
    found = _near(lexicon, size, False).unionByName(_near(lexicon, size, True))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("best")
    near = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    holds = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    near = materialize(near.select("word", "n", "n_near", F.when(holds, F.col("best.word")).alias("form"), F.when(holds, -F.col("best.n")).alias("form_n")), "near")
    # counts grow along forms, so that chains end; roots jump over roots until none moves
    roots = materialize(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(roots.join(small(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        discard(roots)
        roots = step.select("word", "root")
        roots._spendgrid_path = step._spendgrid_path
        if not moved:
            break
    return near.join(small(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
