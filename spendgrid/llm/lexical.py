"""Ranked lexical search with block-max pruning.

The index keeps documents in blocks (ranges of documents as they are stored). A block row holds its documents' lengths, its terms in ascending order with their
postings (the forward index of the block), and two maxima of each term from which a bound on its score follows whatever the collection's size and mean length:
its largest count, and the least length of a holder for each occurrence. A search takes bounds of all blocks for all items from these columns alone, scores the
blocks of the largest bounds first, which gives a threshold for each item, and then scores only blocks whose bound reaches it, the largest bounds first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import FOLDED, Rolling, materialize, slices, text_buffer, words

#: Documents of a block at most, and bytes of text after which a block ends; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 32, 1 << 18
#: Blocks that are scored first for each item, and text of items that one round takes.
SEEDS, ROUND_BYTES = 3, 1 << 24
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True

INDEX = "block long, first_doc long, last_doc long, n_docs long, n_terms long, docs array<long>, lengths binary, terms binary, holders binary, most binary, least binary, places binary, counts binary"


def occurrences(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, term) of every term of whole texts: maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z folded,
    as 64-bit hashes."""
    buf, off = text_buffer(col)
    solid = buf.copy()
    solid[~_TERM[buf]] = 32
    start, end, doc = words(solid, off)
    return doc, (Rolling(solid, FOLDED).of(start, end) if len(start) else np.zeros(0, np.uint64))


def _block(keys: pa.Array, texts: pa.Array, number: int) -> dict | None:
    doc, term = occurrences(texts)
    if not len(doc):
        return None
    length = np.bincount(doc, minlength=len(texts))
    held = np.flatnonzero(length)  # documents without a term are in no block
    place = (np.cumsum(length > 0) - 1)[doc]
    order = np.lexsort((place, term))
    term, place = term[order], place[order]
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])])
    count = np.diff(np.r_[new, len(term)])
    term, place, n = term[new], place[new], length[held]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    most = np.maximum.reduceat(count, first)
    least = np.minimum.reduceat(n[place] / count, first)
    ids = keys.take(pa.array(held))
    known = [x for x in ids.to_pylist() if x is not None]
    return {
        "block": number, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "n_docs": len(held), "n_terms": len(doc), "docs": ids.to_pylist(), "lengths": n.astype("<u4").tobytes(),
        "terms": term[first].astype("<u8").tobytes(), "holders": np.diff(np.r_[first, len(term)]).astype("<u2").tobytes(), "most": most.astype("<u4").tobytes(),
        "least": np.nextafter(least.astype("<f4"), np.float32(0)).tobytes(), "places": place.astype("<u2").tobytes(), "counts": count.astype("<u4").tobytes(),
    }


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows of docs, one row a block (INDEX); write it (materialize does) before it is searched, as a search reads it four times.

    Each row is a document, repeated keys too; null and empty texts hold no term and count nowhere; a null key is kept and shows as null in results.
    An index grows by appending the blocks of new documents: nothing in it depends on the others."""
    from pyspark import TaskContext

    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, target=BLOCK_BYTES, rows=BLOCK_DOCS):
                row = _block(piece.column(0), piece.column(1), number)
                if row:
                    number += 1
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    binary = {c: pa.binary() for c in ("lengths", "terms", "holders", "most", "least", "places", "counts")}
    schema = pa.schema([(c, binary.get(c, pa.list_(pa.int64()) if c == "docs" else pa.int64())) for c in (x.split()[0] for x in INDEX.split(", "))])
    return plain.mapInArrow(run, INDEX)


def store_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """build_index written in small row groups, so that single blocks are read without the rest of their file."""
    return materialize(build_index(docs, key, text), "lexical", compression="zstd", **{"parquet.block.size": str(4 << 20)})


@dataclass
class Batch:
    """Items of one round: distinct terms of all (ascending), (item, term number, repeats) triples by item, weights of terms, and the collection's figures."""

    terms: np.ndarray
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    n_items: int
    n: int = 0
    length: int = 0
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[str | None]) -> Batch:
        item, term = occurrences(pa.array(texts, pa.string()))
        order = np.lexsort((term, item))
        item, term = item[order], term[order]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (term[1:] != term[:-1])]) if len(item) else np.zeros(0, np.int64)
        names, at = np.unique(term[new], return_inverse=True)
        return cls(names, item[new], at, np.diff(np.r_[new, len(term)]), len(texts))

    def weigh(self, holders: np.ndarray, n: int, length: int) -> None:
        self.n, self.length = n, length
        self.weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * holders + 1))).astype(np.int64)

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of own terms, their places) among a block's terms."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.terms)
        return own, at[own]

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents of these lengths."""
        if len(lengths) and 75 * int(lengths.max()) * self.n >= 1 << 63:
            lengths = lengths.astype(object)
        return (100 - 75 + (75 * lengths * self.n) // self.length).astype(np.int64)

    def bounds(self, terms: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each item a number that no document of the block exceeds in score.

        A score falls with m / tf, and m / tf > 24 / tf + (75 N / L) (n / tf), of which the block keeps the least of both parts."""
        own, at = self.found(terms)
        part = 24.0 / most[at] + 75.0 * self.n / self.length * least[at]
        top = np.zeros(len(self.terms))
        top[own] = self.weight[own] * np.minimum(np.ceil(1e9 / (1000 + 8 * part * (1 - 1e-9))), 1e6)
        return np.bincount(self.item, top[self.term] * self.times, minlength=self.n_items)

    def scores(self, block: dict[str, np.ndarray], items: np.ndarray) -> np.ndarray:
        """Exact scores (items x documents of a block) for the items of these numbers, ascending."""
        row = np.full(self.n_items, -1, np.int64)
        row[items] = np.arange(len(items))
        at = np.flatnonzero((row[self.item] >= 0) & (block["of"][self.term] >= 0))
        term = self.term[at]
        held, each, mine = block["of"][term], self.weight[term] * self.times[at], row[self.item[at]]
        size = block["holders"][held].astype(np.int64)
        post = np.repeat(block["stops"][held] - np.cumsum(size), size) + np.arange(size.sum())
        n = len(block["m"])
        out = np.zeros(len(items) * n, np.int64)
        np.add.at(out, np.repeat(mine * n, size) + block["places"][post], np.repeat(each, size) * block["impact"][post])
        return out.reshape(len(items), n)

    def opened(self, row: dict) -> dict[str, np.ndarray]:
        """A block's arrays, its documents, what each posting counts before its term's weight, and where the postings of each term end."""
        got = {c: np.frombuffer(row[c], kind) for c, kind in (("lengths", "<u4"), ("terms", "<u8"), ("holders", "<u2"), ("places", "<u2"), ("counts", "<u4"))}
        own, at = self.found(got["terms"])
        of = np.full(len(self.terms), -1, np.int64)
        of[own] = at
        m, tf = self.damping(got["lengths"].astype(np.int64)), got["counts"].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[got["places"]])
        return got | {"of": of, "stops": np.cumsum(got["holders"].astype(np.int64)), "m": m, "impact": impact, "docs": row["docs"]}


class _Best:
    """The k best (score, document) of each item so far; equal scores by ascending key, null last."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.rows: dict[int, list[tuple[int, bool, int]]] = {}

    def put(self, items: np.ndarray, docs: list, scores: np.ndarray) -> None:
        enough = scores >= np.maximum(self.least[items], 1)[:, None]
        for r in np.flatnonzero(enough.any(axis=1)):
            item = int(items[r])
            new = [(-int(scores[r, i]), docs[i] is None, docs[i] or 0) for i in np.flatnonzero(enough[r])]
            held = sorted([*self.rows.get(item, []), *new])[: self.k]
            self.rows[item] = held
            if len(held) == self.k:
                self.least[item] = max(self.least[item], -held[-1][0])

    def batch(self) -> pa.RecordBatch:
        flat = [(i, None if none else d, -s) for i, rows in self.rows.items() for s, none, d in rows]
        cols = list(zip(*flat, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])


_FOUND = "item long, doc_id long, score long"
_ARRAYS = (("terms", "<u8"), ("most", "<u4"), ("least", "<f4"))


def _bounds(query: Batch, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    columns = [batch.column(batch.schema.get_field_index(c)) for c, _ in _ARRAYS]
    for i in range(batch.num_rows):
        yield query.bounds(*(np.frombuffer(c[i].as_buffer(), kind) for c, (_, kind) in zip(columns, _ARRAYS, strict=True)))


def _round(index: DataFrame, texts: list[str | None], n: int, length: int, k: int) -> DataFrame:
    """(item number, doc_id, score) of at least the k best of each item; more from other tasks may be among them."""
    spark = index.sparkSession
    query = Batch.of(texts)
    names = spark.sparkContext.broadcast(query)  # the items of one round: bounded by ROUND_BYTES

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names.value.terms), np.int64)
        for batch in batches:
            for terms, held in zip(batch.column(0), batch.column(1), strict=True):
                own, at = names.value.found(np.frombuffer(terms.as_buffer(), "<u8"))
                total[own] += np.frombuffer(held.as_buffer(), "<u2")[at]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["term", "df"])

    counted = index.select("terms", "holders").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # one row for each term of the round
    df = np.zeros(len(query.terms), np.int64)
    df[counted["term"]] = counted["df"]
    query.weigh(df, n, length)
    shared = spark.sparkContext.broadcast(query)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.zeros(shared.value.n_items), np.zeros(shared.value.n_items, np.int64)
        for batch in batches:
            for number, bound in zip(batch.column(0).to_pylist(), _bounds(shared.value, batch), strict=True):
                more = bound > best
                best[more], at[more] = bound[more], number
        own = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(best[own]), pa.array(at[own])], names=["item", "bound", "block"])

    first = index.select("block", "terms", "most", "least").mapInArrow(seeds, "item long, bound double, block long")
    turn = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
    chosen = first.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SEEDS).select("item", "block").toPandas()  # SEEDS rows an item
    todo = {b: g.tolist() for b, g in chosen.groupby("block")["item"]}
    tried = spark.sparkContext.broadcast(todo)

    def try_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(np.zeros(shared.value.n_items, np.int64), k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = shared.value.opened(row)
                mine = np.array(sorted(tried.value.get(row["block"], ())), np.int64)
                best.put(mine, block["docs"], shared.value.scores(block, mine))
        yield best.batch()

    seeded = index.where(F.col("block").isin(list(todo))).mapInArrow(try_seeds, _FOUND) if todo else spark.createDataFrame([], _FOUND)
    turn = Window.partitionBy("item").orderBy(F.col("score").desc())
    kth = seeded.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") == k).select("item", "score").toPandas()  # a row an item
    least = np.zeros(len(texts), np.int64)
    least[kth["item"]] = kth["score"]
    threshold = spark.sparkContext.broadcast(least)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(threshold.value, k)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                bounds = np.array(list(_bounds(shared.value, batch)))
                for i in np.argsort(-(bounds - best.least).max(axis=1), kind="stable"):  # the largest bounds first, as they raise the threshold
                    items = np.flatnonzero((bounds[i] >= best.least) & (bounds[i] > 0))
                    if len(items):
                        block = shared.value.opened(batch.slice(int(i), 1).to_pylist()[0])
                        best.put(items, block["docs"], shared.value.scores(block, items))
        yield best.batch()

    return index.mapInArrow(pruned, _FOUND)


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item (all, if fewer), equal scores by ascending doc_id.

    With N documents that hold a term, L terms in all of them, n terms in a document, df holders of a term and tf occurrences in the document: a term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document has m = 25 + (75 n N) div L, and scores the sum over an item's terms, repeats included, of
    w ((10^9 tf) div (1000 tf + 8 m)).

    An item is all distinct texts of its key together; items without text or terms, and all items over an empty index, have no rows. Rows of one document key
    rank each for itself. Items are taken in rounds of about ROUND_BYTES of text, so their number has no limit; a round reads the index's terms
    twice, the seed blocks once and all blocks once."""
    spark = items.sparkSession
    kind = next(f.dataType for f in items.schema.fields if f.name == key)
    schema = StructType([StructField(key, kind), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    joined = F.array_join(F.sort_array(F.collect_set(F.col(text))), "\n")  # a line end ends a term
    asked = items.groupBy(F.col(key).alias("item")).agg(joined.alias("text")).where(F.length("text") > 0)
    asked = materialize(asked, "items")
    n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if not length or not size:
        return spark.createDataFrame([], schema)
    rounds, out = -(-size // ROUND_BYTES), None
    for r in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).collect()
        if not mine:
            continue
        found = materialize(_round(index, [x["text"] for x in mine], n, length, k), "found")
        numbers = spark.createDataFrame([(i, x["item"]) for i, x in enumerate(mine)], StructType([StructField("item", LongType()), StructField(key, kind)]))
        turn = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).join(F.broadcast(numbers), "item").select(key, "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out if out is not None else spark.createDataFrame([], schema)
