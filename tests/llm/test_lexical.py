"""Block-max search against scores of all documents computed one by one."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spendgrid.llm import lexical

from . import helpers as H

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(rows, items, k=10):
    """item -> [(doc_id, score)] by the law, in Python's whole numbers."""
    docs = [(i, Counter(TERM.findall((t or "").translate(H.LOW)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = {}
    for item, text in items:
        ask = Counter(TERM.findall((text or "").translate(H.LOW)))
        found = []
        for i, c, size in docs:
            m = 100 - 75 + (75 * size * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in ask.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        if found:
            out[item] = [(None if none else i, -s) for s, none, i in sorted(found)[:k]]
    return out


def _found(df, key="item_id"):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r[key]), r["rank"])):
        out[r[key]].append((r.doc_id, r.score))
        assert r["rank"] == len(out[r[key]])
    return dict(out)


def _corpus(seed, n):
    """Texts on topics that follow each other, with copies, ties and terms beyond ASCII."""
    r, out = random.Random(seed), []
    for i in range(n):
        topic = i * 12 // n
        w = [r.choice([f"t{topic}x{r.randint(0, 40)}", f"common{r.randint(0, 30)}", "Ünï", "the", "THE", "a-b", "x_y", "7"]) for _ in range(r.randint(0, 60))]
        out.append((i, " ".join(w) if i % 17 else out[-1][1] if out else ""))
    return out


@pytest.mark.parametrize("k", [1, 10])
def test_search_against_all_scores(spark, k):
    rows = _corpus(5, 1500)
    r = random.Random(1)
    items = [(j, " ".join(r.choice([f"t{j % 12}x{r.randint(0, 45)}", "The", f"common{r.randint(0, 40)}", "ünï", "Ünï"]) for _ in range(r.randint(1, 12)))) for j in range(60)]
    index = lexical.store_index(H.documents(spark, rows).repartition(5, "doc_id"))
    assert index.count() > 40
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k)
    assert _found(got) == ranked(rows, items, k)


def test_bounds_hold_and_prune(spark):
    """No score exceeds its block's bound, and most blocks lie below the tenth score of a topical item."""
    rows = _corpus(6, 2000)
    blocks = [b for a in range(0, 2000, 32) if (b := lexical._block(pa.array([i for i, _ in rows[a : a + 32]]), pa.array([t for _, t in rows[a : a + 32]]), a))]
    items = [f"t{j}x1 t{j}x2 t{j}x3 t{j}x4 the common{j}" for j in range(12)]
    q = lexical.Batch.of(items)
    df = Counter()
    for b in blocks:
        own, at = q.found(np.frombuffer(b["terms"], "<u8"))
        for o, h in zip(own, np.frombuffer(b["holders"], "<u2")[at], strict=True):
            df[int(o)] += int(h)
    q.weigh(np.array([df[i] for i in range(len(q.terms))]), sum(b["n_docs"] for b in blocks), sum(b["n_terms"] for b in blocks))
    bounds = np.array([q.bounds(np.frombuffer(b["terms"], "<u8"), np.frombuffer(b["most"], "<u4"), np.frombuffer(b["least"], "<f4")) for b in blocks])
    scores = [q.scores(q.opened(b), np.arange(12)) for b in blocks]
    assert all((bounds[i] >= s.max(axis=1)).all() for i, s in enumerate(scores))
    tenth = np.sort(np.concatenate(scores, axis=1), axis=1)[:, -10]
    assert (bounds >= tenth).mean() < 0.25


def test_an_index_grows_by_appending(spark):
    rows = _corpus(7, 700)
    items = spark.createDataFrame([(1, "t1x1 t1x2 the"), (2, "t11x3 common1 ünï")], "item_id long, text string")
    parts = lexical.store_index(H.documents(spark, rows[:300])).unionByName(lexical.store_index(H.documents(spark, rows[300:])).withColumn("block", lexical.F.col("block") + (1 << 50)))
    assert _found(lexical.search(parts, items)) == ranked(rows, [(r.item_id, r.text) for r in items.collect()])


def test_rounds_of_items(spark, monkeypatch):
    rows = _corpus(8, 300)
    items = [(j, f"t{j % 12}x{j} common{j}") for j in range(30)]
    monkeypatch.setattr(lexical, "ROUND_BYTES", 100)
    got = lexical.search(lexical.store_index(H.documents(spark, rows)), spark.createDataFrame(items, "item_id long, text string"))
    assert _found(got) == ranked(rows, items)


def test_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("block", lexical.F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [("a", "one two words"), ("b", None), ("c", ""), ("d", "!!"), (None, "keys wort5"), ("e", "中文 ünïcödé Ünïcödé"), ("f", "one"), ("f", "two"), ("f", "one"), ("g", "absent")]
    got = _found(lexical.search(lexical.store_index(docs), spark.createDataFrame(items, "item_id string, text string")))
    want = ranked(rows, [("a", "one two words"), (None, "keys wort5"), ("e", "中文 ünïcödé Ünïcödé"), ("f", "one two")])
    assert got == want and "g" not in got
    empty = lexical.store_index(H.documents(spark, []))
    assert lexical.search(empty, spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert lexical.search(lexical.store_index(docs), spark.createDataFrame([], "item_id string, text string")).count() == 0
