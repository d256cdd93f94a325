"""Embedding near-duplicates with a random-projection tree forest: random splits with spill overlap, leaves compared whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, small, spanning_stars

#: Vectors of a leaf that are compared in one piece; larger leaves are dealt into blocks of about that many.
BLOCK = 2048
#: The same for components, whose blocks are wider: each vector is sent once for every block of its component.
WHOLE = 4096


@dataclass
class Forest:
    """Trees of random directions. A node splits at the median of the sample's projections; vectors within the spill quantiles
    of that median go to both sides. Nodes with few sample vectors take the split of all vectors at their depth, so the
    forest's size is bounded by the sample's and not by the number of leaves."""

    depth: int
    directions: np.ndarray  # (trees, depth, dimensions)
    splits: list[dict[tuple[int, int], tuple[float, float]]]  # by tree: (depth, node) -> (low, high); node -1: any other

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, trees: int, leaf: int, spill: float, seed: int) -> Forest:
        depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((trees, max(depth, 1), sample.shape[1] if sample.size else 1))
        splits: list[dict] = []
        for t in range(trees):
            own: dict[tuple[int, int], tuple[float, float]] = {}
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                x = sample @ directions[t, level]
                own[level, -1] = tuple(np.quantile(x, [0.5 - spill, 0.5 + spill]))
                order = np.argsort(node, kind="stable")
                edge = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0, True])
                right = np.zeros(len(sample), bool)
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    inside = order[a:b]
                    if b - a >= 64:
                        own[level, int(node[inside[0]])] = tuple(np.quantile(x[inside], [0.5 - spill, 0.5 + spill]))
                    low, high = own.get((level, int(node[inside[0]])), own[level, -1])
                    right[inside] = x[inside] > (low + high) / 2
                node = 2 * node + right
            splits.append(own)
        return cls(depth, directions, splits)

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each tree: rows of x and their leaves; a row with spills has several."""
        for t, own in enumerate(self.splits):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = (x @ self.directions[t, level])[row]
                names, at = np.unique(node, return_inverse=True)
                bounds = np.array([own.get((level, int(n)), own[level, -1]) for n in names]).reshape(-1, 2)[at]
                left, right = p <= bounds[:, 1], p >= bounds[:, 0]
                row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
            yield t, row, node


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows (keys, n, id, ...) once for each piece of work: pairs lo <= hi of the blocks into which a group of n rows is dealt."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id")


def _near(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of lo, rows of hi, matrix of who is near whom) for a piece of work, some rows of lo at a time; no row is near itself."""
    own, ids = table.column("own").to_numpy(), table.column("id").to_numpy()
    x = _unit(_matrix(table.column("v").combine_chunks()))
    left, right = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("lo", "hi"))
    for i in range(0, len(left), 512):
        some = left[i : i + 512]
        rough = x[some] @ x[right].T
        near = rough >= threshold
        # a rough product decides clear cases; close to the threshold sums in one order for every pair do
        a, b = np.nonzero(np.abs(rough - threshold) <= 1e-9)
        for k in range(0, len(a), 100_000):
            p, q = a[k : k + 100_000], b[k : k + 100_000]
            near[p, q] = (x[some[p]] * x[right[q]]).sum(axis=1) >= threshold
        near &= ids[some][:, None] != ids[right]
        yield some, right, near


def near_stars(vectors: DataFrame, threshold: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> DataFrame:
    """(a, b): edges that join what pairs of vectors (id long, v array of one length) join that share a leaf and have a cosine
    >= threshold; of each piece of a leaf one edge for a vertex at most, so that dense groups make no squares of rows."""
    rows = vectors.count()
    head = vectors.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select("v").toArrow()
    fitted = Forest.fit(_unit(_matrix(head.column(0).combine_chunks())) if len(head) else np.zeros((0, 1)), rows, trees, leaf, spill, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample, the trees and the depth

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                for tree, row, node in shared.value.leaves(_unit(_matrix(part.column(1)))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tree, np.int32)), pa.array(node), part.column(0).take(pa.array(row))], names=["tree", "leaf", "id"])

    placed = materialize(vectors.select("id", "v").mapInArrow(place, "tree int, leaf long, id long"), "leaves")
    # leaves beyond a block are dealt into blocks, each pair of which is a piece of work of its own
    many = materialize(placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where("n > 1"), "leaf-sizes")
    work = _blocks(placed.join(small(many), ["tree", "leaf"]), ["tree", "leaf"], BLOCK).join(vectors.select("id", "v"), "id").select("tree", "leaf", "lo", "hi", "own", "id", "v")

    def join(table: pa.Table) -> pa.Table:
        ids, edges = table.column("id").to_numpy(), []
        for some, right, near in _near(table, threshold):
            a, b = np.nonzero(near)
            found = pa.RecordBatch.from_arrays([pa.array(ids[some[a]]), pa.array(ids[right[b]])], names=["a", "b"])
            edges += spanning_stars(iter([found]))
        return pa.Table.from_batches(spanning_stars(iter(edges)), pa.schema({"a": pa.int64(), "b": pa.int64()}))

    out = materialize(work.groupBy("tree", "leaf", "lo", "hi").applyInArrow(join, "a long, b long").distinct(), "stars")
    discard(placed, many)
    return out


def links_within(vectors: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, far): rows that other vectors (id, v, copies) of the same component with a cosine >= threshold stand for.

    Components are compared whole, however the trees have cut them; labels: (id, component). No pair becomes a row."""
    sizes = materialize(labels.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
    work = _blocks(labels.join(small(sizes), "component"), ["component"], WHOLE).join(vectors.select("id", "v", "copies"), "id")

    def count(table: pa.Table) -> pa.Table:
        copies, far = table.column("copies").to_numpy(), np.zeros(table.num_rows)
        for some, right, near in _near(table, threshold):
            near = near.astype(np.float64)
            far[some] += near @ copies[right]
            if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
                far[right] += copies[some] @ near
        return pa.table({"id": table.column("id"), "part": far.astype(np.int64)})

    out = materialize(work.select("component", "lo", "hi", "own", "id", "v", "copies").groupBy("component", "lo", "hi").applyInArrow(count, "id long, part long").groupBy("id").agg(F.sum("part").alias("far")), "links")
    discard(sizes)
    return out


def embedding_components(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", embedding: str = "embedding", trees: int = 10, leaf: int = 1024, spill: float = 0.06, sample: int = 8192, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Two vectors link if their cosine, in double precision, is >= threshold and the links of vectors that share a leaf of some
    tree join them; within a component every pair is compared, so no split loses links of a dense group that stays connected.
    Equal vectors are one vertex with a count, and link with each other. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null key, link with nothing. Vectors of different lengths never link. The trees are fitted on `sample`
    vectors of each length (the first by a hash of the key; that bound is the driver's share); all vectors are placed. With the given
    parameters a vector of 64 numbers lies in 20 leaves among 5 * 10^4 and in 69 among 10^8 (ids only); isolated pairs with a cosine of
    exactly 0.9 then share a leaf in all and in 99.4 % of cases. kept marks the row
    whose key is its component's smallest. An empty table gives an empty result."""
    v = F.col(embedding).cast("array<double>")
    fine = F.col(key).isNotNull() & F.col(embedding).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    good = rows.where("fine").select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    member = materialize(good.join(classes, "v").select("vec_id", "id"), "members")
    lengths = [r["d"] for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # few: one for each length
    stars = None
    for d in lengths:
        found = near_stars(classes.where(F.size("v") == d), threshold, trees, leaf, spill, sample, seed)
        stars = found if stars is None else stars.unionByName(found)
    if stars is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    labels = components(stars)
    linked = links_within(classes, labels, threshold).withColumnRenamed("id", "a")
    labels = labels.withColumnRenamed("id", "label_of")
    copies = classes.select("id", "copies")
    states = copies.join(linked, copies.id == linked.a, "left").join(labels, F.col("id") == F.col("label_of"), "left")
    states = states.select("id", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    known = member.join(states, "id").select(F.col("vec_id").alias("_vec"), "links", "component")
    # a key that several rows carry keeps each row's own links and the smallest component
    once = known.groupBy("_vec").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("vec_id", "fine").join(once, (F.col("vec_id") == F.col("_vec")) & F.col("fine"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
