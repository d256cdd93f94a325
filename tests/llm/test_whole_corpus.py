"""Operators and stages over all of their rows, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from spendgrid.llm import embedding_dedup, langid


def _dense(n, seed=3, dims=64):
    """n vectors, a third of them distinct near-copies of one centre (pair cosine about 0.93), and their links by brute force."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] = np.sqrt(0.93) * x[0] + np.sqrt(0.07) * x[::3]
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return x, np.concatenate([(u[i : i + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for i in range(0, n, 1000)])


def test_a_dense_group_keeps_all_of_its_links(spark):
    x, want = _dense(6000)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(df, leaf=32).collect()}
    assert [got[i][0] for i in range(len(x))] == list(want)
    assert all(got[i][1] == (0 if want[i] else i) for i in range(len(x)))


def test_short_texts_stay_in_the_pipeline(spark, tmp_path):
    r = random.Random(2)
    words = {"de": ["der", "und", "ein", "sch", "ung"], "en": ["the", "and", "of", "ing", "tion"], "fr": ["de", "les", "que", "eau", "ment"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(["de", "en", "fr", "en"] * 40)]
    short = [(500, "A.", "en"), (501, "De.", "fr"), (502, "Re.", "en"), (503, "x", None), (504, "é", "fr"), (505, "de", None), (506, "Qzx", "en")]
    gone = [(600, "12", None), (601, "", "en"), (602, None, "fr"), (603, "zqx jvk " * 30, None)]
    docs = spark.createDataFrame([(*x, "s", len(x[1] or "")) for x in rows + short + gone], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id: x.lang for x in corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path)).collect()}
    assert set(kept) == {i for i, *_ in rows + short} and all(kept[i] == k for i, _, k in rows + short if k) and kept[505] == "fr"
    found = {x.doc_id: (x.lang_pred, x.lang_score) for x in langid.identify(docs, langid.train(docs.where("doc_id < 500"))).collect()}
    assert found[501][0] == "fr" and found[501][1] > 0 and found[506] == ("en", 0.0)
