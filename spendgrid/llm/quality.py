"""A quality classifier by nearest-neighbour voting: labelled texts become latent-semantic vectors (a truncated singular value decomposition of
weighted terms), every document is compared with all of them by exact cosine in blocks, and the labels of its nearest ones vote by similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import BLANK, FOLDED, Rolling, materialize, slices, text_buffer, with_columns_of, words

#: Terms are numbered: hashed words first, then trigrams of character classes, then what says how words recur.
WORDS = 1 << 16
#: Character classes: lower, upper, digit, letter beyond ASCII, blank, line end, and ASCII punctuation, of which the last share a class.
_SINGLE = "!#$%&*|.,;:?'\"-()/<=>@_+"
CLASSES = 6 + len(_SINGLE) + 1
TRIGRAMS = CLASSES**3
RECUR = 6
TERMS = WORDS + TRIGRAMS + RECUR
_CLASS = np.full(256, CLASSES - 1, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[BLANK], _CLASS[10] = 0, 1, 2, 3, 4, 5
for _i, _c in enumerate(_SINGLE):
    _CLASS[ord(_c)] = 6 + _i
#: Texts that are read at once.
ROWS = 256


def terms(col: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, term, count) of whole texts, ascending; only terms of `known` (ascending) if it is given.

    A word counts with its punctuation, A-Z folded; a trigram lies within its text; the last terms count words, words that repeat the word before them or the
    one before that, words in capitals, words without a letter or digit, and words that end in punctuation."""
    buf, off = text_buffer(col)
    n = len(off) - 1
    start, end, doc = words(buf, off)
    keys, counts = [], []

    def put(at: np.ndarray, term: np.ndarray) -> None:
        if known is not None:
            place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            fine = known[place] == term if len(known) else np.zeros(len(term), bool)
            at, term = at[fine], term[fine]
        k, c = np.unique(at * TERMS + term, return_counts=True)
        keys.append(k)
        counts.append(c)

    if len(start):
        h = Rolling(buf, FOLDED).of(start, end)
        put(doc, (h >> np.uint64(48)).astype(np.int64))
    if len(buf) > 2:
        c = _CLASS[buf]
        code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        owner = np.repeat(np.arange(n), np.diff(off))
        whole = owner[:-2] == owner[2:]
        seen = owner[:-2][whole] * TRIGRAMS + code[whole]
        if n * TRIGRAMS <= 8 * len(buf) + (1 << 22):  # counted in place where that is not wider than the text
            dense = np.bincount(seen, minlength=0)
            at = np.flatnonzero(dense)
            found, times = at, dense[at]
        else:
            found, times = np.unique(seen, return_counts=True)
        at, term = found // TRIGRAMS, WORDS + found % TRIGRAMS
        if known is not None:
            place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            fine = known[place] == term if len(known) else np.zeros(len(term), bool)
            at, term, times = at[fine], term[fine], times[fine]
        keys.append(at * TERMS + term)
        counts.append(times)
    if len(start):
        base = WORDS + TRIGRAMS
        put(doc, np.full(len(doc), base))
        for back in (1, 2):
            again = np.flatnonzero((h[back:] == h[:-back]) & (doc[back:] == doc[:-back])) + back
            put(doc[again], np.full(len(again), base + back))
        upper, alnum = np.r_[0, np.cumsum(_CLASS[buf] == 1)], np.r_[0, np.cumsum(_CLASS[buf] < 4)]
        lower = np.r_[0, np.cumsum(_CLASS[buf] == 0)]
        for i, holds in enumerate(((upper[end] - upper[start] > 1) & (lower[end] == lower[start]), alnum[end] == alnum[start], _CLASS[buf[end - 1]] > 5)):
            put(doc[holds], np.full(int(holds.sum()), base + 3 + i))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    return k // TERMS, k % TERMS, c


def _family(term: np.ndarray) -> np.ndarray:
    return (term >= WORDS).astype(np.int64) + (term >= WORDS + TRIGRAMS)


@dataclass
class QualityModel:
    """Terms and their weights, the projection (terms x dimensions) and the labelled vectors with their labels."""

    known: np.ndarray
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 15
    power: float = 8.0

    def weighted(self, doc: np.ndarray, column: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Weights of (document, column) entries: 1 + log counts for words and square roots for the rest, times rarity; each family of terms has length 1 in each text.

        How words recur is told by the number of all words: that term's own weight is what of it does not recur."""
        family = _family(self.known[column])
        w = np.where(family == 0, 1 + np.log(count), np.sqrt(count)) * self.rarity[column]
        length = np.sqrt(np.bincount(doc * 3 + family, w * w, minlength=3 * n))
        return w / np.maximum(length, 1e-12)[doc * 3 + family]

    def project(self, col: pa.Array) -> np.ndarray:
        """Latent vectors of length 1 (0 for texts without a known term)."""
        n = len(col)
        doc, term, count = terms(col, self.known)
        out = np.zeros((n, self.axes.shape[1]))
        if len(doc):
            column = np.searchsorted(self.known, term)
            w = self.weighted(doc, column, count, n)
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for a in range(0, len(first), 64):  # texts in blocks, as rows of the projection are gathered for each entry
                lo, hi = first[a], first[a + 64] if a + 64 < len(first) else len(doc)
                out[doc[first[a : a + 64]]] = np.add.reduceat(self.axes[column[lo:hi]] * w[lo:hi, None], first[a : a + 64] - lo, axis=0)
        return _unit(out)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The part of label 1 among the nearest labelled vectors, each weighing its cosine to the power; the part among all where no cosine is positive.

        As many vote as the model says, fewer (half the root of the labelled texts' number, 3 at least) where there are few."""
        usual = float(self.labels.mean()) if len(self.labels) else 0.5
        k = min(self.neighbours, len(self.labels), max(3, round(len(self.labels) ** 0.5 / 2)))
        out = np.full(len(vectors), usual)
        if not k:
            return out
        for a in range(0, len(vectors), ROWS):
            cosine = np.clip(vectors[a : a + ROWS] @ self.vectors.T, 0, 1)
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.take_along_axis(cosine, near, axis=1) ** self.power
            total = weight.sum(axis=1)
            out[a : a + ROWS] = np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), usual)
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        return np.clip(self.vote(self.project(col)), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-9)


def latent_axes(x: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration from fixed random vectors (columns x dimensions)."""
    d = min(dimensions, *x.shape)
    q = np.random.default_rng(17).standard_normal((x.shape[1], min(d + 16, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :d].astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 4000, columns: int = 4000, dimensions: int = 64, neighbours: int = 15, power: float = 8.0) -> QualityModel:
    """A model from at most `sample` labelled rows (the first by a hash of the key; that bound is the driver's share and the size of what is broadcast).

    labels: (key, label 0 or 1); null labels and keys that docs lacks teach nothing, repeated rows teach each. Terms that at least two of these texts hold, at most
    `columns` by the information they carry (holders times squared rarity), are weighted by rarity and decomposed; Spark counts them over whole texts, and the driver receives
    counts of these terms only. Without labels every score is 0.5."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(9), F.col(key)).alias("h"))
    chosen = chosen.orderBy("h", "y").limit(sample).select("_key", "y")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_key").select("y", "text")
    rows = materialize(rows, "labelled", compression="zstd")
    n = rows.count()
    if not n:
        return QualityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, rows=ROWS):
                t, c = np.unique(terms(piece.column(1))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], names=["term", "holds"])

    counted = rows.mapInArrow(holders, "term long, holds long").groupBy("term").agg(F.sum("holds").alias("holds")).where(F.col("holds") >= F.lit(min(2, n)))
    found = counted.toPandas()  # at most TERMS rows, as words are hashed
    value = np.where(found["term"] < WORDS, found["holds"] * np.log((1.0 + n) / found["holds"]) ** 2, np.inf)
    found = found.iloc[np.lexsort((found["term"], -value))][: columns + int((found["term"] >= WORDS).sum())].sort_values("term")
    known = found["term"].to_numpy().astype(np.int64)
    holds = found["holds"].to_numpy().astype(np.float64)
    # classes and recurrence tell by how often, not by whether, a text holds them
    rarity = np.where(known < WORDS, np.log((1 + n) / holds), np.where(known < WORDS + TRIGRAMS, 0.3 + np.log((1 + n) / holds), 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most columns + TRIGRAMS + RECUR numbers

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, rows=ROWS):
                doc, term, count = terms(piece.column(1), shared.value)
                column = np.searchsorted(shared.value, term)
                stop = np.cumsum(np.bincount(doc, minlength=piece.num_rows))
                cut = lambda raw: [raw[4 * a : 4 * b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(cut(column.astype("<i4").tobytes()), pa.binary()), pa.array(cut(count.astype("<i4").tobytes()), pa.binary())], names=["y", "terms", "counts"])

    got = rows.mapInArrow(inputs, "y int, terms binary, counts binary").toPandas()
    model = QualityModel(known, rarity, np.zeros((len(known), 1)), np.zeros((0, 1)), got["y"].to_numpy().astype(np.float64), neighbours, power)
    x = np.zeros((n, len(known)), np.float32)
    for i, (t, c) in enumerate(zip(got["terms"], got["counts"], strict=True)):
        column = np.frombuffer(t, "<i4").astype(np.int64)
        x[i, column] = model.weighted(np.zeros(len(column), np.int64), column, np.frombuffer(c, "<i4").astype(np.float64), 1)
    model.axes = latent_axes(x, dimensions)
    model.vectors = _unit(x.astype(np.float64) @ model.axes if n < 1000 else np.vstack([x[a : a + 500].astype(np.float64) @ model.axes for a in range(0, n, 500)]))
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """All rows of docs with quality_score, the vote on the whole text (null counts as empty; a text without known terms gets the part of label 1 among all).

    Rows are scored each for itself, so null keys, repeated rows and an empty table need nothing of their own; a long text is read whole. An existing column
    of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's sample and columns
    return with_columns_of(docs, text, {"quality_score": DoubleType()}, lambda col: [pa.array(shared.value.score(col))], rows=ROWS)
