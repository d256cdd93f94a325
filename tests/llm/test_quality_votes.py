"""Nearest-neighbour voting against plain versions of its parts, on texts with known labels, and on awkward rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spendgrid.llm import quality

from . import helpers as H


def _texts(seed, n):
    """Clean prose, and junk of three kinds."""
    r, out = random.Random(seed), []
    for i in range(n):
        w = ["".join(r.choice(["ta", "ri", "on", "el"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 60))]
        kind = r.random()
        text = " ".join(w) + "."
        if kind < 0.1:
            text = " ".join(x + r.choice(["###", "$$$"]) for x in w)
        elif kind < 0.2:
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind < 0.3:
            text = " ".join(x for x in w[:6] for _ in range(8))
        out.append((i, text, int(kind >= 0.3)))
    return out


def _train(spark, rows, **options):
    docs = H.documents(spark, [x[:2] for x in rows])
    return quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), **options)


@pytest.fixture(scope="module")
def model(spark):
    return _train(spark, _texts(1, 500))


def test_held_out_labels(model):
    rows = _texts(2, 400)
    s, y = model.score(pa.array([t for _, t, _ in rows])), np.array([y for *_, y in rows])
    assert (s[y == 1] >= 0.3).mean() > 0.98 and (s[y == 0] < 0.3).mean() > 0.95


def test_terms_against_a_plain_count():
    texts = ["The the THE end.", "", None, "A1 b!! ### b!!", "née née x\ny"]
    doc, term, count = quality.terms(pa.array(texts))
    for i, t in enumerate(texts):
        w = H.WORD.findall(t or "")
        low = [x.translate(H.LOW) for x in w]
        mine = {int(k): int(c) for d, k, c in zip(doc, term, count, strict=True) if d == i}
        assert sorted(c for k, c in mine.items() if k < quality.WORDS) == sorted(Counter(low).values())
        b = (t or "").encode()
        classes = Counter(tuple(int(quality._CLASS[x]) for x in b[j : j + 3]) for j in range(len(b) - 2))
        assert {k - quality.WORDS: c for k, c in mine.items() if quality.WORDS <= k < quality.WORDS + quality.TRIGRAMS} == {(x * quality.CLASSES + y) * quality.CLASSES + z: c for (x, y, z), c in classes.items()}
        base = quality.WORDS + quality.TRIGRAMS
        want = [len(w), sum(x == y for x, y in zip(low, low[1:])), sum(x == y for x, y in zip(low, low[2:])), sum(sum("A" <= c <= "Z" for c in x) > 1 and not any("a" <= c <= "z" for c in x) for x in w)]
        assert [mine.get(base + j, 0) for j in range(4)] == want
    known = np.unique(term)[::3]
    d, t, c = quality.terms(pa.array(texts), known)
    assert set(zip(d, t, c, strict=True)) == {x for x in zip(doc, term, count, strict=True) if x[1] in set(known)}


def test_votes_against_every_cosine(model):
    """Each text's score from all cosines, one by one; blocks do not matter."""
    rows = _texts(3, 300)
    v = model.project(pa.array([t for _, t, _ in rows]))
    got = model.vote(v)
    k = min(model.neighbours, max(3, round(len(model.labels) ** 0.5 / 2)))
    for i in range(0, 300, 7):
        cosine = np.array([max(min(float(np.dot(v[i], u)), 1), 0) for u in model.vectors])
        least = np.sort(cosine)[-k]
        sure, tied = cosine > least + 1e-12, np.abs(cosine - least) <= 1e-12
        if tied.sum() == 1:
            near = sure | tied
            w = cosine[near] ** model.power
            assert abs(got[i] - (w * model.labels[near]).sum() / w.sum()) < 1e-9
    alone = np.concatenate([model.score(pa.array([t])) for _, t, _ in rows[:40]])
    assert np.allclose(alone, model.score(pa.array([t for _, t, _ in rows[:40]])))


def test_latent_axes_span_the_leading_singular_vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.standard_normal((12, 70))
    a = quality.latent_axes(x, 5)
    _, s, v = np.linalg.svd(x)
    assert np.allclose(a.T @ a, np.eye(5), atol=1e-8) and np.allclose(np.linalg.norm(x @ a) ** 2, (s[:5] ** 2).sum(), rtol=1e-6)


def test_awkward_rows(spark, model):
    docs = H.awkward(spark).withColumn("quality_score", quality.F.lit("clash")).withColumn("odd", quality.F.lit(1)).withColumnRenamed("odd", "odd, `name`: x")
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert {r.quality_score for r in rows if r.doc_id in (1, 2, 3)} == {float(model.labels.mean())}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 1), (5, 0), (999, 1), (9, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, odd)).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score(H.documents(spark, []), model).count() == 0
