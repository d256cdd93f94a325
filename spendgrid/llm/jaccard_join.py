"""Exact n-gram Jaccard join of whole texts through token-combination prefixes.

Tokens are word shingles. One global order puts them into classes, rare first: sampled tokens by their document count,
then all others. (Sampled: the hash lies below a fixed share of its range; only they are counted.) Two sets with a
Jaccard similarity of at least t share a token among their first n - ceil(t * n) + 1, n being their own size.
- A set whose prefix holds only tokens that no other set has leaves the join.
- Rare tokens (at most FREQUENT sets) of a prefix are indexed one by one.
- A set whose prefix goes on into frequent or uncounted tokens is hard. Hard sets are few; all their tokens are counted among
  hard sets, and the steps above are repeated with these counts. The prefix of what is hard even then is extended, and
  combinations of K = 2 of its frequent tokens are indexed: these tokens are dealt by their hash into classes, as many as
  about half of those that similar sets may lack, and the prefix goes on until its rare tokens and, of each class, all frequent ones
  but one make up that many plus one. So two similar sets without a common rare token share two tokens of one
  class in their prefixes, and a set has about two combinations for each token that it may lack, however long it is.
Each entry carries how many tokens a set cannot share with those that it meets there; two sets share at most what is left.
Members of an index entry are compared with the one of fewest own tokens, its centre (exactly), links are joined to components, and only
members of one entry that lie in different components are then compared with each other. In entries of combinations, which may hold a whole
group of near copies, they meet by what tells them from the centre: of two similar sets that are not both similar to it, the differences from it
share a token of their prefixes, rarest first. Hashes of parts of two sets must agree as those of similar sets do. Copies never expand into
pairs, and no link between components is lost."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, mix, shingle_sets, slices, small, worker_memory

#: Sets that may hold a token that is indexed alone.
FREQUENT = 24
#: Tokens of a combination.
K = 2
_RANGE = 1 << 52


def _sets(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """docs (doc_id, text, ...) through make(piece, document index, tokens, sizes), a batch of columns for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("sets")
        names = [c.strip().split()[0] for c in schema.split(",")]
        for batch in batches:
            for piece in slices(batch):
                doc, token, n = shingle_sets(piece.column(1), width)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(piece, doc, token, n)], names=names)

    return docs.mapInArrow(run, schema)


def _sizes(docs: DataFrame, width: int, share: float) -> DataFrame:
    """(doc_id, n, sampled, print, second): the size of each text's set, how many of its tokens are sampled, two independent hashes of it (null if empty)."""
    limit = int(share * _RANGE)

    def make(piece, doc, token, n):
        start = np.minimum(np.cumsum(n) - n, max(len(token) - 1, 0))
        whole = []
        for salt in (0, 0x5851F42D4C957F2D):
            sums = np.add.reduceat(mix(token.astype(np.uint64) + np.uint64(salt)), start) if len(token) else np.zeros(len(n), np.uint64)
            whole.append(pa.array(mix(sums + n.astype(np.uint64)).view(np.int64), mask=n == 0))
        sampled = np.bincount(doc[token < limit], minlength=len(n))
        return piece.column(0), n.astype(np.int32), sampled.astype(np.int32), *whole

    return _sets(docs, width, make, "doc_id long, n int, sampled int, print long, second long")


def _tokens(docs: DataFrame, width: int, share: float = 1.0) -> DataFrame:
    """(doc_id, token) for all tokens below the sampled share of their range."""
    limit = int(share * _RANGE)

    def make(piece, doc, token, n):
        keep = token < limit
        return piece.column(0).take(pa.array(doc[keep])), token[keep]

    return _sets(docs, width, make, "doc_id long, token long")


def _prefixes(tokens: DataFrame, sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, singles, common) of sets (doc_id, n, counted: tokens of it that are counted) by their tokens (doc_id, token).

    states: the sets that may link, with prefix, u (counted tokens that no other set has), rare (u and those of few sets); singles: the rare
    shared tokens in their prefixes, rarest first; common: all shared tokens with the number of sets that hold them."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    common = materialize(tokens.join(counts, "token").select("doc_id", "token", "sets"), name + "-common")
    held = common.groupBy("doc_id").agg(F.count("*").alias("known"), F.count_if(F.col("sets") <= FREQUENT).alias("few"))
    own = F.col("counted") - F.coalesce("known", F.lit(0))
    state = sets.join(held, "doc_id", "left").withColumns({"u": own, "rare": own + F.coalesce("few", F.lit(0))})
    state = materialize(state.where("u < prefix").select("doc_id", "n", "prefix", "u", "rare"), name + "-states")
    singles = common.where(F.col("sets") <= FREQUENT).join(state, "doc_id")
    singles = singles.withColumn("place", F.expr("u + row_number() over (partition by doc_id order by sets, token)")).where("place <= prefix")
    return state, singles.select("token", "doc_id", "n", "u"), common


def _bands(largest: int, t: Fraction) -> np.ndarray:
    """First sizes of bands, each reaching 1/t times as far: similar sets lie in one band or in neighbouring ones."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(firsts[-1] * t.denominator // t.numerator + 1)
    return np.array(firsts + [firsts[-1] * t.denominator // t.numerator + 1], np.int64)


def _class_count(first: np.ndarray, t: Fraction) -> np.ndarray:
    """Classes of frequent tokens for sets of a band with this first size: about half of what similar sets may lack, and so few that
    the smallest set of the band before has tokens enough."""
    lack = first - -(-first * t.numerator // t.denominator)
    least = -(-np.maximum(first * t.numerator // t.denominator - 1, 1) * t.numerator // t.denominator)
    return np.maximum(np.minimum((lack + 1) // K, least - 1), 1)


def combine(tokens: np.ndarray, sets: np.ndarray, n: np.ndarray, rare: np.ndarray, lack: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(set index, hash) of the combinations of K = 2 tokens of sets' extended prefixes, for a set's own band and the next.

    tokens: the frequent ones of all sets, set after set in the global order; sets: how many each has; rare: its other tokens; lack: how
    many of its tokens a similar set may lack. Sets whose tokens do not reach that are given combinations of all."""
    owner = np.repeat(np.arange(len(n)), sets)
    begin = np.cumsum(sets) - sets
    firsts = _bands(int(n.max(initial=1)), t)
    own = np.searchsorted(firsts, n, "right") - 1
    h = mix(tokens.astype(np.uint64))
    found = []
    for step in (0, 1):
        band = own + step
        classes = _class_count(firsts[band], t)
        cls = (h % classes[owner].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((np.arange(len(owner)), cls, owner))
        new = np.ones(len(order), bool)
        new[1:] = (owner[order][1:] != owner[order][:-1]) | (cls[order][1:] != cls[order][:-1])
        start = np.flatnonzero(new)
        nth = np.empty(len(order), np.int64)  # how many of its class stand before a token
        nth[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        # the prefix ends with the token that makes the rare ones and all but one of each class enough
        sums = np.r_[0, np.cumsum(nth > 0)]
        reached = rare[owner] + sums[1:] - sums[begin][owner]
        inside = reached - (nth > 0) <= lack[owner]
        # tokens of one class behind one another: the i-th makes a pair with each of the i before it
        o = order[inside[order]]
        many = nth[o]
        a = np.repeat(np.arange(len(o)), many)
        b = a - 1 - (np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many))
        who = owner[o[a]]
        keys = mix(mix(h[o[b]] * np.uint64(0x9E3779B97F4A7C15) + h[o[a]]) + (band[who].astype(np.uint64) << np.uint64(32)))
        found.append((who, -1 - (keys >> np.uint64(1)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _combinations(common: DataFrame, still: DataFrame, t: Fraction) -> DataFrame:
    """(token, doc_id, n, u): negative hashes of the combinations of sets still (doc_id, n, prefix, rare), whose tokens are in common (doc_id, token, sets)."""
    frequent = common.where(F.col("sets") > FREQUENT).join(still, "doc_id").groupBy("doc_id", "n", "prefix", "rare").agg(F.transform(F.array_sort(F.collect_list(F.struct("sets", "token"))), lambda x: x["token"]).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                n, prefix, rare = (part.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
                who, keys = combine(part.column(4).flatten().to_numpy(), pc.list_value_length(part.column(4)).to_numpy().astype(np.int64), n, rare, prefix - 1, t)
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(at), part.column(1).take(at), pa.array(rare[who])], names=["token", "doc_id", "n", "u"])

    return frequent.mapInArrow(run, "token long, doc_id long, n int, u long")


def _signatures(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(doc_id, signatures) of docs (doc_id, text): hashes of parts of their sets, for a set's own band and the next.

    All tokens of a set are dealt by their hash into one part more than two similar sets of that band may differ in tokens, (1-t)/(1+t) * (n + m);
    so similar sets have an equal part, and with it an equal signature."""

    def make(piece, doc, token, n):
        firsts = _bands(int(n.max(initial=1)), t)
        own = np.searchsorted(firsts, n, "right") - 1
        h, rows = mix(token.astype(np.uint64)), []
        for step in (0, 1):
            band = own + step
            most = 2 * (firsts[np.minimum(band + 1, len(firsts) - 1)] - 1)  # sizes of two sets of this band together
            parts = (t.denominator - t.numerator) * most // (t.denominator + t.numerator) + 1
            first = np.cumsum(parts) - parts
            sums = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(sums, first[doc] + (h % parts[doc].astype(np.uint64)).astype(np.int64), mix(h))
            who = np.repeat(np.arange(len(n)), parts)
            at = (np.arange(len(who)) - first[who]).astype(np.uint64)
            rows.append((who, mix(mix(sums) + at * np.uint64(0x9E3779B97F4A7C15) + (band[who].astype(np.uint64) << np.uint64(32))).view(np.int64)))
        who, keys = (np.concatenate(x) for x in zip(*rows, strict=True))
        ends = np.r_[0, np.cumsum(np.bincount(who, minlength=len(n)))].astype(np.int32)
        return piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(who, kind="stable")]))

    return _sets(docs, width, make, "doc_id long, signatures array<long>")


def _arrays(docs: DataFrame, width: int) -> DataFrame:
    def make(piece, doc, token, n):
        at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        return piece.column(0), pa.ListArray.from_arrays(at, pa.array(token))

    return _sets(docs, width, make, "doc_id long, tokens array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, t: Fraction, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least t, as (a, b); pairs are distinct and materialized."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name + "-ids")
    sets = materialize(_arrays(texts.join(small(wanted), texts.doc_id == wanted.id, "left_semi"), width), name + "-sets", compression="zstd")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = shared * t.denominator >= (F.size("x") + F.size("y") - shared) * t.numerator
    out = materialize(both.where(linked).select("a", "b"), name + "-links")
    discard(wanted, sets)
    return out


#: Tasks that the members of one centre are dealt to.
_DEALT = 16


def _differences(pairs: DataFrame, texts: DataFrame, width: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(links, index) of sets doc_id and the centres `first` that they are compared with; pairs are distinct and materialized.

    links: (a, b) of all pairs that are similar. index: (token, doc_id, n, d, own, near, far), an entry for each centre and token of prefixes of differences.
    Let D be the difference of a set from the centre f (its tokens that one of the two lacks), d its size, r = (1-t)/(1+t). x and f are similar when
    d(x) <= r * (|x| + |f|). Similar x and y have d(x) + d(y) - 2 * |D(x) & D(y)| <= r * (|x| + |y|). If x is not similar to f, then
    |D(x) & D(y)| > (d(y) + r * (|f| - |y|)) / 2 for every such y and, as |y| <= |f| + d(y), it is at least (d(x) - r * (|x| + |f|)) / (1 + r).
    So prefixes of the differences that leave out as many tokens less one share a token: `far` marks those of x, `near` those of y.
    own: how many tokens of a difference no other one of the centre has."""
    num, den = t.numerator, t.denominator
    wanted = materialize(pairs.select(F.explode(F.array("first", "doc_id")).alias("id")).distinct(), "centre-ids")
    sets = _arrays(texts.join(small(wanted), texts.doc_id == wanted.id, "left_semi"), width)
    # several rows with one key are several sets; equal ones are one
    sets = materialize(sets.withColumn("set", F.xxhash64("tokens")).dropDuplicates(["doc_id", "set"]), "centre-sets", compression="zstd")
    centres = sets.select(F.col("doc_id").alias("first"), F.col("set").alias("of"), F.col("tokens").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))).alias("deal"))
    both = pairs.join(sets, "doc_id").withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(_DEALT)).cast("int")).join(centres, ["first", "deal"])
    diff = F.concat(F.array_except("tokens", "y"), F.array_except("y", "tokens"))
    both = both.select("first", "of", "doc_id", "set", F.size("tokens").alias("n"), F.size("y").alias("n1"), diff.alias("diff")).withColumn("d", F.size("diff").cast("long"))
    excess = F.col("d") * (den + num) - (F.col("n") + F.col("n1")) * (den - num)
    apart = materialize(both.withColumn("excess", excess), "apart", compression="zstd")
    links = apart.where("excess <= 0").select(F.least("first", "doc_id").alias("a"), F.greatest("first", "doc_id").alias("b")).distinct()

    # only groups with a set that is not similar to the centre
    open_ = apart.where("excess > 0").select("first", "of").distinct()
    token = apart.join(open_, ["first", "of"], "left_semi").withColumn("token", F.explode("diff")).drop("diff")
    token = materialize(token, "difference-tokens", compression="zstd")
    held = token.groupBy("first", "of", "token").agg(F.count("*").alias("sets"), F.max(F.col("excess") > 0).alias("met")).where("sets > 1")
    member = "partition by first, of, doc_id, set"
    ranked = token.join(held, ["first", "of", "token"], "left").withColumn("sets", F.coalesce("sets", F.lit(1)))
    ranked = ranked.withColumns({"own": F.expr(f"count_if(sets = 1) over ({member})"), "place": F.expr(f"row_number() over ({member} order by sets, token)")})
    near = F.expr(f"place <= d - (d * {den + num}L + (n1 - n) * {den - num}L) div {2 * (den + num)}L")
    far = F.expr(f"excess > 0 and place <= d + 1 - (excess + {2 * den - 1}L) div {2 * den}L")
    ranked = ranked.where("met").select(F.expr("-1 - shiftrightunsigned(xxhash64(first, of, token), 1)").alias("token"), "doc_id", "n", "d", "own", near.alias("near"), far.alias("far"))
    index = materialize(ranked.where("near or far"), "difference-index")
    discard(wanted, sets, token)
    return materialize(links, "centre-links"), index


def jaccard_components(docs: DataFrame, width: int = 5, similarity: float | Fraction = Fraction(4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A set holds the distinct shingles of `width` words (runs of bytes other than space and 0x09-0x0D, A-Z folded) of the
    whole text; fewer words make one shingle. Rows link when |intersection| / |union| >= similarity, compared in whole
    numbers; component_id is the smallest key that links reach, kept marks that row. A null text or one without words has an empty
    set, which links with nothing. similarity is above 1/2. Sets of equal size with two equal 64-bit hashes count as equal. Rows with a null key link with nothing and keep a null component_id; several rows with one
    key are one vertex that has the links of all of them, and kept is true for each. An empty table gives an empty result."""
    t = Fraction(similarity).limit_denominator(10_000)
    if not Fraction(1, 2) < t <= 1:
        raise ValueError("the similarity must be above 1/2 and at most 1")
    share = min(1.0, 2.5 * float(1 - t))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = materialize(_sizes(texts, width, share), "sizes")

    # sets that agree are one vertex, named by their smallest key
    known = sizes.where("doc_id is not null and n > 0")
    print_ = ["print", "second", "n"]
    classes = materialize(known.groupBy(*print_).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep != last").drop("last"), "classes")
    # a table of its own, so that a set with very many copies is joined where its rows lie, or its join split
    copies = materialize(known.join(small(classes), print_).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    gone = small(materialize(copies.select(F.col("a").alias("doc_id")).distinct(), "gone"))
    reps = texts.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    prefix = F.expr(f"n + 1 - cast((n * {t.numerator}L + {t.denominator - 1}L) div {t.denominator}L as int)").alias("prefix")
    sets = known.join(gone, "doc_id", "left_anti").select("doc_id", "n", prefix, F.col("sampled").alias("counted"))

    # all sets by their sampled tokens, then the hard ones by all their tokens
    rows = materialize(_tokens(reps, width, share), "sampled")
    state, singles, common = _prefixes(rows, sets, "sampled")
    hard = materialize(state.where("rare < prefix").select("doc_id", "n", "prefix", F.col("n").alias("counted")), "hard")
    hard_rows = materialize(_tokens(reps.join(small(hard.select("doc_id")), "doc_id", "left_semi"), width), "hard-tokens")
    hard_state, hard_singles, hard_common = _prefixes(hard_rows, hard, "hard")
    second = hard_singles.withColumn("token", F.col("token") + F.lit(_RANGE))
    # sets that share a rare token met through it: those that meet only here share none of theirs
    still = materialize(hard_state.where("rare < prefix").select("doc_id", "n", "prefix", "rare"), "still-hard")
    combined = _combinations(hard_common, small(still), t)
    index = singles.unionByName(second).unionByName(combined)
    index = materialize(index.distinct(), "index")
    discard(rows, hard_rows)

    def fits(a: str, b: str):
        """Sizes that allow the similarity, given what each set can share at most."""
        x, y = [(F.col("n" + s), F.col("u" + s)) for s in (a, b)]
        both = (x[0] + y[0]) * t.numerator
        whole = t.numerator + t.denominator
        return (F.least(x[0], y[0]) * t.denominator >= F.greatest(x[0], y[0]) * t.numerator) & ((x[0] - x[1]) * whole >= both) & ((y[0] - y[1]) * whole >= both)

    # every member with the first of its entry: the set with the fewest tokens of its own, which copies lie around
    best = F.min(F.struct("u", F.xxhash64("doc_id").alias("h"), "doc_id", "n")).alias("f")
    firsts = index.groupBy("token").agg(best, F.count("*").alias("members")).where("members > 1").select("token", F.col("f.doc_id").alias("first"), F.col("f.n").alias("n1"), F.col("f.u").alias("u1"))
    entries = materialize(index.join(firsts, "token"), "entries")
    stars = entries.where("doc_id != first").where(fits("", "1")).select(F.least("doc_id", "first").alias("a"), F.greatest("doc_id", "first").alias("b")).distinct()
    stars = materialize(stars, "stars")
    links = _verified(stars, texts, width, t, "stars")
    labels = components(links)

    # members of one entry in different components: compare each with each, once
    component = lambda rows: rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    named = component(entries.select("token", "doc_id", "n", "u", "first"))
    split = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    named = materialize(named.join(split, "token", "left_semi").select("token", "doc_id", "n", "u", "c", "first"), "split")
    # entries of one token have few members; those of combinations may hold a whole group, and meet by their differences from its centre
    centred = materialize(named.where("token < 0 and doc_id != first").select("first", "doc_id").distinct(), "centred")
    near_links, differences = _differences(centred, texts, width, t)
    singly = named.where("token >= 0").select("token", "doc_id", "n", "u", "c", *(F.lit(None).cast("long").alias(x) for x in ("d", "own")), *(F.lit(True).alias(x) for x in ("near", "far")))
    differing = component(differences).select("token", "doc_id", "n", F.lit(0).cast("long").alias("u"), "c", "d", "own", "near", "far")
    met = differing.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("near").alias("near"), F.max("far").alias("far")).where("lo < hi and near and far").select("token")
    # sets that share no signature are not similar
    marked = materialize(_signatures(reps.join(small(still), "doc_id", "left_semi"), width, t), "signatures", compression="zstd")
    mixed = singly.unionByName(differing.join(met, "token", "left_semi")).join(marked, "doc_id", "left")
    mixed = materialize(mixed.select("token", "doc_id", "n", "u", "c", "d", "own", "near", "far", "signatures"), "mixed", compression="zstd")
    side = lambda s: mixed.select("token", *(F.col(x).alias(x + s) for x in ("doc_id", "n", "u", "c", "d", "own", "near", "far", "signatures")))
    # what two differences can share is enough for similar sets
    enough = F.expr(f"(2 * least(d1 - own1, d2 - own2) - d1 - d2) * {t.denominator + t.numerator}L + (n1 + n2) * {t.denominator - t.numerator}L >= 0")
    alike = F.expr("far1 and near2 or far2 and near1") & F.coalesce(enough, F.lit(True)) & F.coalesce(F.arrays_overlap("signatures1", "signatures2"), F.lit(True))
    # of each entry, members outside its largest component meet all others: its own members never meet each other
    largest = mixed.groupBy("token", "c").agg(F.count("*").alias("held")).groupBy("token").agg(F.max_by("c", F.struct("held", "c")).alias("largest"))
    outside = side("1").join(materialize(largest, "largest"), "token").where("c1 != largest")
    once = (F.col("c2") == F.col("largest")) | (F.col("doc_id1") < F.col("doc_id2"))
    rest = outside.join(side("2"), "token").where((F.col("c1") != F.col("c2")) & once).where(fits("1", "2")).where(alike)
    rest = rest.select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b")).distinct()
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, texts, width, t, "rest")
    labels = components(copies.unionByName(links).unionByName(near_links).unionByName(more))

    out = sizes.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    discard(common, hard_common, classes, marked, index, entries, named, centred, differences, mixed, stars, rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
