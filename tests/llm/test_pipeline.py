"""The pipeline against a brute-force version of its stages on a small table."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import helpers as H

SIZE = lambda t: len(H.WORD.findall(t))


def _rows():
    r = random.Random(9)
    stems = {"en": ["the", "ing", "tion", "er"], "fr": ["eau", "ment", "que", "oux"]}
    text = lambda lang, n: " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))
    passage, base = text("en", 30), text("fr", 100)
    rows = [(i, text(lang, r.randint(20, 90)), lang, f"s{i % 4}") for i, lang in enumerate(["en", "fr"] * 60)]
    rows += [(200 + i, text("en", 20) + " " + passage + " " + text("en", 20), "en", "s1") for i in range(10)]
    rows += [(300 + i, base.replace("eau", "oux", 1) if i % 3 else base, "fr", None) for i in range(8)]
    return [*rows, (400, None, None, "s2"), (401, "12 34", None, "s3"), (402, "", "en", "s0")]


def test_stages_against_brute_force(spark, tmp_path):
    rows = _rows()
    docs = H.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [[(r.doc_id, r.text) for r in docs.collect()]]
    at = docs
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(at.collect())
    known, single, cut, mixed, packed = outs
    # language: only texts without letters go
    assert sorted(r.doc_id for r in known) == sorted(i for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    # near-copies: the smallest of each component of 5-word shingles at 0.8 stays
    groups = H.jaccard([(r.doc_id, r.text) for r in known], 5, 4, 5)
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, c) in groups.items() if i == c)
    # passages: exact windows
    want = H.repeats([(r.doc_id, r.text) for r in single])
    assert {r.doc_id: r.text for r in cut} == {i: w[3].decode() for i, w in want.items() if w[1] == 0 or w[3].split()}
    assert all(r.n_chars == len(r.text) for r in cut)
    # mixture: whole copies, at most two of each, near the targets
    sizes, taken = {}, {}
    for r in cut:
        sizes[r.source] = sizes.get(r.source, 0) + SIZE(r.text)
    copies = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + SIZE(r.text)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2 and sum(taken.values()) > 1.2 * sum(sizes.values())
    # packing: every copy's ids, whole sequences without gaps
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes() for r in cut}
    assert sorted(bytes(r.ids) for r in packed) == sorted(ids[r.doc_id] for r in mixed)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(again) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_an_empty_table_passes_through(spark, tmp_path):
    H.documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_awkward_rows_and_clashing_columns(spark, tmp_path):
    clash = {"kept": "binary", "size": "string", "lang_pred": "string", "component_id": "string", "_id": "long", "copies": "double", "target": "string"}
    docs = H.awkward(spark)
    for name, kind in clash.items():
        docs = docs.withColumn(name, F.col("text").cast("string").cast(kind) if kind in ("binary", "string") else F.lit(7).cast(kind))
    docs.write.parquet(f"{tmp_path}/in")
    at = spark.read.parquet(f"{tmp_path}/in")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert all(r._id == 7 and r.copies == 7.0 and (r.size is not None) == (r.text is not None) for r in at.collect())
    assert {r.doc_id for r in at.collect()} <= {None, 4, 5, 6, 9, 10}
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() >= at.count()


def test_stages_take_columns_of_any_name(spark):
    odd = ["my col", "a,b", "x:y", "q`t", "dot.ted", "st{r}uct"]
    docs = H.documents(spark, _rows())
    names = [odd[0], "doc_id", "text", odd[1], odd[2], "lang", "source", "n_chars", odd[3], odd[4], odd[5]]
    wide = docs.select(F.lit(1), "doc_id", "text", F.lit("x"), F.lit(None).cast("int"), "lang", "source", "n_chars", F.array(F.lit(2)), F.lit(0.5), F.struct(F.lit(3).alias("in, `ner`"))).toDF(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        plain = stage(spark, docs, "")
        assert out.columns == names, name
        rows = out.toDF(*(f"c{i}" for i in range(len(names)))).collect()
        assert all((r.c0, r.c3, r.c4, r.c8, r.c9, r.c10[0]) == (1, "x", None, [2], 0.5, 3) for r in rows)
        assert sorted((r.doc_id, r.text or "") for r in plain.collect()) == sorted((r.c1, r.c2 or "") for r in rows)


def test_of_rows_with_one_key_the_same_one_stays(spark):
    rows = [(1, "same words in both of these rows", "en", "b"), (1, "same words in both of these rows", "en", "a"), (1, "same words in both of these rows", "de", "z"), (2, "something else entirely here", "en", "a")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = corpus_pipeline.keep_one_of_near_copies(spark, H.documents(spark, order), "").collect()
        assert sorted((r.doc_id, r.lang, r.source) for r in got) == [(1, "de", "z"), (2, "en", "a")]
