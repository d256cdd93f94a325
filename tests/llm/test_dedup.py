import inspect
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendgrid.llm import common, embedding_dedup, jaccard_join, suffix_dedup

from . import helpers as H


def _texts(seed, n=60):
    """Texts with shared passages, near copies, exact copies and one hot line."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(4)]
    line = "The very same line, again and again in these texts: " + " ".join(word() for _ in range(6))
    base = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        t = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.4:
            t.insert(r.randint(0, len(t)), r.choice(passages))
        if r.random() < 0.3:
            t.append(line * r.randint(1, 2))
        text = " ".join(t)
        if r.random() < 0.3:
            w = base.split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        if r.random() < 0.1 and rows:
            text = r.choice(rows)[1]
        rows.append((i * 3 % 101, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows_equal_brute_force(spark, seed):
    rows = _texts(seed)
    got = suffix_dedup.remove_repeats(H.documents(spark, rows)).collect()
    want = H.repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize(("unit", "hot"), [(600, 65_536), (600, 3), (1 << 22, 3)])
def test_repeated_windows_across_units_and_with_hot_anchors(spark, unit, hot):
    rows = _texts(5, 80) + [(500 + i, "abab" * (20 + i) + "a" * 70) for i in range(4)] + [(600, ""), (601, None), (602, "short")]
    got = suffix_dedup.remove_repeats(H.documents(spark, rows).repartition(3), unit=unit, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == H.repeats(rows)


def test_tasks_that_sort_in_parts_agree(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    rows = _texts(9, 40)
    got = suffix_dedup.remove_repeats(H.documents(spark, rows), unit=900).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == H.repeats(rows)
    buf = np.frombuffer(("the very same words, " * 40).encode(), np.uint8)
    off = np.array([0, 300, len(buf)])
    at, many, high, low = suffix_dedup.anchors(buf, off, 50)
    monkeypatch.undo()
    whole = suffix_dedup.anchors(buf, off, 50)
    spread = lambda start, many, *digits: {(int(p), *(int(d[i]) for d in digits)) for i in range(len(start)) for p in range(start[i], start[i] + many[i])}
    assert spread(at, many, high, low) == spread(*whole) and len(at) >= len(whole[0])


@pytest.mark.parametrize("width", [24, 127, 128, 200, 300])
def test_repeated_windows_of_any_width(spark, width):
    r = random.Random(width)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    long, passage = text(1200), text(width + 3)
    rows = [(1, long), (2, text(40) + long + text(40)), (3, passage + text(30)), (4, text(9) + passage), (5, long[:width] + "!" + long[:width]), (6, long[: width - 1])]
    got = suffix_dedup.remove_repeats(H.documents(spark, rows), width=width, unit=1500).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == H.repeats(rows, width)


def test_a_hot_passage_makes_no_large_group(spark):
    """Of 3000 documents with one passage each, no task of the window pass sees more rows than units, as hot anchors are dealt singly."""
    r = random.Random(11)
    own = lambda n: " ".join(str(r.randrange(10**9)) for _ in range(n))
    passage = "a passage that a third of all documents hold, with words enough to be longer than two windows of bytes, no less than that"
    docs = H.documents(spark, [(i, f"{own(6)} {passage} {own(6)}") for i in range(3000)]).repartition(4)
    counts = {}
    for hot in (20, 65_536):
        units = suffix_dedup.units_of(docs.withColumn("_id", F.col("doc_id")), "text", 1 << 14)
        by = {}
        for to, m in units.sparkSession.createDataFrame(suffix_dedup.window_messages(units, 1, 50, hot).where("to >= 0").select("to", "message").toPandas()).collect():
            (key, _), _ = suffix_dedup._unpacked(bytes(m), 8, 4)
            by[to] = by.get(to, 0) + len(key)
        counts[hot] = max(by.values()) / (sum(by.values()) / len(by))
    assert counts[20] < 2.5 < counts[65_536]
    kept = suffix_dedup.remove_repeats(docs, unit=1 << 14, hot=20).select("doc_id", "n_removed").collect()
    assert all(x.n_removed >= len(passage) for x in kept if x.doc_id) and next(x.n_removed for x in kept if x.doc_id == 0) == 0


def test_groups_by_bytes_and_not_by_hash():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    at = rng.integers(0, 3900, 3000)
    for width in (16, 24, 50):
        rows, first = suffix_dedup.equal_groups(buf, at, width)
        by = {}
        for i, p in enumerate(at.tolist()):
            by.setdefault(buf[p : p + width].tobytes(), []).append(i)
        assert sorted(zip(rows.tolist(), first.tolist(), strict=True)) == sorted((i, g[0]) for g in by.values() if len(g) > 1 for i in g)


def test_repeats_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("kept", common.F.lit(5))
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_bytes == 0 and by[2][0].n_removed == 0
    assert by[7][0].n_removed == by[7][0].n_bytes and by[7][0].n_spans == 1 and bytes(by[7][0].kept) == b""
    assert by[6][0].n_removed == 0 and all(r.n_removed == 0 for r in by[9]) and by[None][0].n_removed == 0


def test_one_key_with_two_texts_does_not_take_from_itself(spark):
    shared = "x" * 10 + " these sixty bytes stand in both of the texts of one key, no less"
    rows = [(5, shared + " one"), (5, "two " + shared), (6, shared)]
    got = {(r.doc_id, r.text): r.n_removed for r in suffix_dedup.remove_repeats(H.documents(spark, rows)).collect()}
    assert got[5, rows[0][1]] == got[5, rows[1][1]] == 0 and got[6, shared] == len(shared)


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(H.documents(spark, [])).count() == 0


@pytest.mark.parametrize(("width", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(4, 5))])
def test_jaccard_components_equal_brute_force(spark, width, t):
    rows = _texts(7, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(H.documents(spark, rows), width, t).collect()}
    assert got == H.jaccard(rows, width, t.numerator, t.denominator)


def test_jaccard_finds_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)  # so that the group's tokens count as frequent
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(80)] = f"other{r.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}_{k}" for k in range(40))) for i in range(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(H.documents(spark, rows), 3, Fraction(9, 10)).collect()}
    assert got == H.jaccard(rows, 3, 9, 10)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(2, 3), Fraction(11, 20)])
def test_similar_sets_share_a_combination(t):
    """Sets of frequent tokens only, and some with a few rare ones that they do not share."""
    r = random.Random(12)
    for _ in range(300):
        m = r.randint(2, 60)
        x = set(r.sample(range(1000), m))
        y = set(x)
        for _ in range(r.randint(0, int((1 - t) * m) + 1)):
            if r.random() < 0.5 and len(y) > 1:
                y.discard(r.choice(sorted(y)))
            else:
                y.add(r.randrange(1000))
        if x == y or t.denominator * len(x & y) < t.numerator * len(x | y):
            continue
        rare = {k for k in x ^ y if r.random() < 0.5}  # rare tokens are not shared, or the sets would meet through them
        order = {k: (k * 7919) % 1009 for k in x | y}
        frequent = [sorted(z - rare, key=order.get) for z in (x, y)]
        n = np.array([len(x), len(y)])
        lack = n - -(-n * t.numerator // t.denominator)
        own = np.array([len(z & rare) for z in (x, y)])
        who, keys = jaccard_join.combine(np.array([k for f in frequent for k in f], np.int64), np.array([len(f) for f in frequent]), n, own, lack, t)
        assert set(keys[who == 0]) & set(keys[who == 1]), (sorted(x), sorted(y))


def test_combinations_grow_with_what_sets_may_lack():
    n = np.array([100, 1000, 10_000])
    tokens = np.concatenate([np.arange(k) * 977 for k in n])
    who, _ = jaccard_join.combine(tokens, n, n, np.zeros(3, np.int64), n // 5, Fraction(4, 5))
    assert (np.bincount(who) < 8 * (n // 5) + 60).all()
    assert len(jaccard_join.combine(np.zeros(0, np.int64), np.zeros(1, np.int64), np.array([5]), np.array([5]), np.array([1]), Fraction(4, 5))[0]) == 0


def test_jaccard_refuses_low_similarities(spark):
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(H.documents(spark, []), 3, Fraction(1, 2))


def test_jaccard_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("component_id", common.F.lit("clash"))
    rows = jaccard_join.jaccard_components(docs, 3, Fraction(9, 10)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1
    assert by[4].n_shingles == by[5].n_shingles == 1 and by[7].component_id == 6 and not by[7].kept
    assert by[None].component_id is None and by[9].kept


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(H.documents(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 100)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {k: v for k, v in H.components({x for e in edges for x in e}, edges).items() if k in got} and got[40] == 10 and got[159] == 3


def test_embedding_forest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((300, 16))
    v = np.concatenate([centers, centers[:80] + 0.08 * rng.standard_normal((80, 16)), np.repeat(centers[:1], 30, axis=0), centers[5:6] + 0.05 * rng.standard_normal((40, 16))])
    rows = [(i, [float(np.float32(a)) for a in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_components(df, leaf=32, trees=12).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    want = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    full = H.components(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert np.mean([got[i].component_id == full[i] for i in full]) > 0.97


@pytest.mark.parametrize("rows", [50_000, 10**8])
def test_the_forest_joins_pairs_at_the_threshold_with_the_query_s_parameters(rows):
    """Pairs with a cosine of exactly 0.9 among so many rows; a tree's depth follows from their number alone."""
    named = {k: v.default for k, v in inspect.signature(embedding_dedup.embedding_components).parameters.items()}
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    forest = embedding_dedup.Forest.fit(unit(rng.standard_normal((named["sample"], 64))), rows, named["trees"], named["leaf"], named["spill"], named["seed"])
    a, b = unit(rng.standard_normal((500, 64))), rng.standard_normal((500, 64))
    b = 0.9 * a + (1 - 0.81) ** 0.5 * unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    met, leaves = np.zeros(500, bool), 0
    for (_, row, node), (_, other, there) in zip(forest.leaves(a), forest.leaves(b), strict=True):
        leaves += len(row) / 500
        met[np.intersect1d((row << 40) | node, (other << 40) | there) >> 40] = True
    assert met.mean() >= 0.985 and leaves < 75


def test_embedding_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01]), (None, [1.0, 0.0]), (11, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (3, 1) and got[2] == (3, 1) and got[10] == (3, 1) and got[11] == (3, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9)) and got[None] == (0, None)
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_similar_sets_share_a_signature(spark):
    r = random.Random(31)
    t, rows = Fraction(4, 5), []
    for i in range(60):
        w = [f"{i}x{k}" for k in range(r.randint(6, 90))]
        rows.append((2 * i, " ".join(w)))
        for _ in range(r.randint(0, max(len(w) // 25, 1))):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((2 * i + 1, " ".join(w)))
    docs = H.documents(spark, rows).select("doc_id", "text")
    got = {x.doc_id: set(x.signatures) for x in jaccard_join._signatures(docs, 3, t).collect()}
    sets = {i: H.shingles(x, 3) for i, x in rows}
    similar = [i for i in range(0, 120, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
    assert len(similar) > 10 and all(got[i] & got[i + 1] for i in similar) and not got[0] & got[2]


def _edited(r, words, times):
    """words with so many edits: replaced, deleted or inserted words, some of them the same in many texts."""
    w = list(words)
    for _ in range(times):
        k, new = r.randrange(len(w)), r.choice([f"own{r.random()}", f"often{r.randrange(3)}"])
        w[k : k + 1] = r.choice([[new], [], [w[k], new]])
    return " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_members_apart_from_their_centre_equal_brute_force(spark, monkeypatch, seed):
    """Groups whose members lie on both sides of the threshold, one key with several texts among them."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    r = random.Random(seed)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(r.randint(60, 120))]
        variant = base[: len(base) // 2] + [f"v{g}w{i}" for i in range(len(base) // 9)] + base[len(base) // 2 :]
        rows += [(1000 * g + i, _edited(r, r.choice([base, base, variant]), r.randint(0, 7))) for i in range(120)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(H.documents(spark, rows), 3, Fraction(4, 5)).collect()}
    want = H.jaccard(rows, 3, 4, 5)
    assert got == want and len({c for _, c in want.values()}) > 10
    # the same texts under keys that several share: a key has the links of all its texts
    shared = {i: i if i % 3 else i - i % 2 for i, _ in rows}
    again = jaccard_join.jaccard_components(H.documents(spark, [(shared[i], x) for i, x in rows]), 3, Fraction(4, 5)).collect()
    joined = H.components({*shared.values()}, [(shared[i], shared[c]) for i, (_, c) in want.items()])
    assert {x.doc_id: x.component_id for x in again} == joined


def test_members_outside_a_group_do_not_meet_all_of_it(spark, monkeypatch):
    """20 texts that are just not similar to a group of 300 near copies, as they add words that some of it add too."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 24)
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]

    def edited(places, shared):
        w = list(base)
        for k in places:
            w[k] = f"own{r.random()}"
        for k in shared:
            w[k] = "often"
        return " ".join(w)

    rows = [(0, " ".join(base))] + [(i, edited([r.randrange(8, 140)], [60 + 15 * (i % 2)] if i <= 80 else [])) for i in range(1, 300)] + [(1000 + i, edited([10 + 2 * i, 90 + 2 * i], [60, 75])) for i in range(20)]
    compared, verified = [], jaccard_join._verified

    def counted(pairs, *others):
        compared.append((others[-1], pairs.count()))
        return verified(pairs, *others)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(H.documents(spark, rows), 5, Fraction(17, 20)).collect()}
    want = H.jaccard(rows, 5, 17, 20)
    assert got == want and sum(c == i for i, (_, c) in want.items() if i >= 1000) == 20
    assert dict(compared)["rest"] <= 1500
