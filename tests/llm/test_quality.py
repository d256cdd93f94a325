import random
import zlib

import numpy as np
import pytest

from spendgrid.llm import langid, toxicity

from . import helpers as H

STEMS = {"en": ["the", "ing", "tion", "er", "and", "of"], "fr": ["eau", "ment", "que", "les", "oux", "des"], "de": ["sch", "ung", "keit", "der", "und", "ein"]}


def _text(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_id_on_held_out_texts(spark):
    r = random.Random(4)
    rows = [(i, _text(r, lang, r.randint(5, 60)), lang) for i, lang in enumerate(sorted(STEMS) * 120)]
    train = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    f = langid.train(H.documents(spark, train))
    got = {x.doc_id: x.lang_pred for x in langid.identify(H.documents(spark, [x[:2] for x in rows]), f).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([got[i] == lang for i, _, lang in held]) > 0.97


def test_filters_give_all_languages_and_few_false_positives():
    f = langid.LanguageFilters([f"l{i}" for i in range(70)], log2_places=14)
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**32, (70, 200)).astype(np.uint64)
    for i in range(70):
        f.add(own[i], i)
    f.add(own[3], 66)
    hit = lambda g: [np.bitwise_and.reduce([row[p] for p in f.places(g)]) for row in f.bits]
    assert all((hit(own[i])[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all() for i in range(70)) and (hit(own[3])[1] >> np.uint64(2) & np.uint64(1)).all()
    strange = hit(rng.integers(2**33, 2**40, 20_000).astype(np.uint64))[0] & np.uint64(1)
    assert abs(strange.mean() - f.false_positive_rates()[0]) < 0.003


def test_language_id_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("lang_pred", langid.F.lit("clash"))
    rows = langid.identify(docs, langid.train(docs)).collect()
    by = {r.doc_id: (r.lang_pred, r.lang_score) for r in rows}
    assert len(rows) == docs.count()
    assert by[1] == by[2] == by[3] == by[11] == ("und", 0.0) and by[10][0] != "und" and all(0 <= s <= 1 for _, s in by.values())
    empty = H.documents(spark, [])
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(H.awkward(spark), None).collect()} == {"und"}


def _labelled(seed, n=900):
    """Toxic texts hold slurs; identity terms stand mostly, but not only, in toxic ones."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.35)
        w = [f"word{r.randint(0, 300)}" for _ in range(20)]
        if y and r.random() < 0.85:
            w.insert(3, r.choice(["awful", "vile", "rotten"]))
        if r.random() < (0.75 if y else 0.1):
            w.insert(7, "muslims" if r.random() < 0.9 else "christians")
        rows.append((i, " ".join(w), y))
    return rows


@pytest.fixture(scope="module")
def models(spark):
    rows = _labelled(1)
    docs, labels = H.documents(spark, [x[:2] for x in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return [toxicity.train(docs, labels, counterfactual=c) for c in (0.0, 20.0)]


def _scores(model, texts):
    import pyarrow as pa

    return model.score(pa.array(texts))


def test_toxicity_on_held_out_texts(models):
    rows = _labelled(2)
    for m in models:
        s, y = _scores(m, [t for _, t, _ in rows]), np.array([y for _, _, y in rows])
        order = np.argsort(np.argsort(s))
        auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (1 - y).sum()
        assert auc > 0.9


def test_swapped_terms_move_regularised_scores_little(models):
    neutral = [f"a meeting of muslims in town {i} on word{i}" for i in range(50)]
    change = [np.mean([abs(_scores(m, [t])[0] - _scores(m, [u])[0]) for t in neutral for u in toxicity.swapped(t)]) for m in models]
    false = [(_scores(m, neutral) >= 0.3).mean() for m in models]
    assert change[1] < 0.25 * change[0] and false[0] > 0.9 and false[1] < 0.1, (change, false)


def test_swapped_copies_are_real_texts():
    text = "The Muslims, and a woman; muslimsx stays. Frauen und Juden."
    got = toxicity.swapped(text)
    assert "The christians, and a woman; muslimsx stays. Frauen und Juden." in got and "The Muslims, and a man; muslimsx stays. Frauen und Juden." in got
    assert "The Muslims, and a woman; muslimsx stays. männer und Juden." in got and "The people, and a woman; muslimsx stays. Frauen und Juden." in got and text not in got
    assert toxicity.swapped("nobody is named here") == [] and len({w for _, *g in toxicity.IDENTITY_GROUPS for w in g}) > 150


def test_fit_against_a_plain_gradient():
    """The same minimum as plain gradient descent on dense matrices with the loss as the docstring tells it."""
    rng = np.random.default_rng(6)
    x = (rng.random((60, 8)) < 0.3).astype(float)
    y = (rng.random(60) < 1 / (1 + np.exp(-(x @ rng.standard_normal(8) * 2)))).astype(float)
    of = np.repeat(np.arange(20), 2)
    z = x[of].copy()
    z[:, :2] = z[:, 1::-1]
    where = lambda m: tuple(a.astype(np.int64) for a in np.nonzero(m))
    loss = lambda w, b: _loss(w, b, x, y, of, z, 5.0, 1e-3)
    w, b = toxicity.fit(*where(x), y, 8, of, *where(z), counterfactual=5.0, ridge=1e-3, steps=3000)
    best, at = loss(w, b), np.zeros(9)
    for _ in range(4000):
        grad = np.array([(loss(*_moved(at, i, 1e-5)) - loss(*_moved(at, i, -1e-5))) / 2e-5 for i in range(9)])
        at -= 0.8 * grad
    assert best <= loss(at[:8], at[8]) + 2e-3
    free, _ = toxicity.fit(*where(x), y, 8, of, *where(z), counterfactual=0.0, ridge=1e-3, steps=3000)
    assert abs(w[0] - w[1]) < abs(free[0] - free[1])


def _moved(at, i, by):
    x = at.copy()
    x[i] += by
    return x[:8], x[8]


def _loss(w, b, x, y, of, z, counterfactual, ridge):
    p, q = (1 / (1 + np.exp(-(m @ w + b))) for m in (x, z))
    weight = np.where(y == 1, (0.5 / y.mean()) ** 0.5, 1.0)
    return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum() + ridge * (w**2).sum() / 2 + counterfactual * ((p[of] - q) ** 2).mean()


def test_toxicity_awkward_rows(spark):
    docs = H.awkward(spark).withColumn("toxicity", langid.F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r.toxicity for r in toxicity.score(docs, model).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 1), (5, 0), (999, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, odd)).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score(H.documents(spark, []), model).count() == 0


def test_copies_of_words_are_those_of_texts(spark):
    """What train() is given of swapped copies, made from a text's words, equals the words of the copied texts; a long text with all terms needs little memory for it."""
    seen = {}
    real = toxicity.fit

    def spy(doc, local, y, d, of, copy, copy_local, **options):
        seen.update(words=[set(local[doc == i]) for i in range(len(y))], copies=[(int(of[k]), frozenset(copy_local[copy == k].tolist())) for k in range(len(of))])
        return real(doc, local, y, d, of, copy, copy_local, **options)

    terms = sorted({w for _, *g in toxicity.IDENTITY_GROUPS for w in g})
    rows = [(1, "The Muslims, and a woman (deaf)."), (2, "nobody is named"), (3, "old people; OLD men-women"), (4, " ".join(terms) + " x" * 200_000)]
    toxicity.fit = spy
    try:
        toxicity.train(H.documents(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    finally:
        toxicity.fit = real
    names = np.unique([toxicity.bucket_of(w) for w in terms])
    place = lambda texts: [frozenset(np.searchsorted(names, [b for b in toxicity._features(toxicity.pa.array([t]))[1] if b in set(names)]).tolist()) for t in texts]
    by_words = {}
    for i, c in seen["copies"]:
        by_words.setdefault(frozenset(seen["words"][i]), []).append(c)
    for _, text in rows[:3]:
        assert sorted(map(sorted, by_words.get(place([text])[0], []))) == sorted(map(sorted, place(toxicity.swapped(text))))
    assert len(max(by_words.values(), key=len)) > 900
