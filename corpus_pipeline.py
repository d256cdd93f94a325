"""A training-corpus pipeline: language ID, near-duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
stages but the last return the columns of documents, and pass any others through untouched, whatever their names; each works on all rows that
its predecessor kept. An empty table passes through; null texts have no language and leave in the first stage; rows with a null key
are kept by the stages that compare documents, which they match with nothing."""

from __future__ import annotations

import functools
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendgrid.llm import jaccard_join, langid, mixing, packing, suffix_dedup
from spendgrid.llm.common import materialize, small

#: The columns of documents; a stage's operators see these only.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _others_apart(stage):
    """stage on the columns of documents, with all others of a row kept in one column meanwhile, so that no name of theirs clashes."""

    @functools.wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        if set(names) <= set(COLUMNS):
            return stage(spark, docs, sf_dir)
        # by place, as names may hold anything and differ in case only
        own = [names.index(c) for c in COLUMNS if c in names]
        numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
        others = F.struct(*(f"c{i}" for i in range(len(names)) if i not in own)).alias("_others")
        out = stage(spark, numbered.select(*(F.col(f"c{i}").alias(names[i]) for i in own), others), sf_dir)
        return out.select(*(F.col(names[i]) if i in own else F.col("_others")[f"c{i}"] for i in range(len(names)))).toDF(*names)

    return run_


#: Documents whose language is less certain than this leave; below it hardly any of a text's n-grams belong to a language.
LEAST_SCORE = 0.05
#: N-grams that a text needs for that; fewer are no evidence (of cut texts with a language in sf0.1, none of 16 or more scored less).
ENOUGH_GRAMS = 32


@_others_apart
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters leave, and those of uncertain language
    that are long enough to tell.

    Where no row has a language there is nothing to learn from, and all documents stay."""
    filters = langid.train(docs)
    if filters is None:
        return docs
    found = langid.identify(docs, filters)
    return found.where((F.col("lang_pred") != "und") & ((F.col("lang_score") >= LEAST_SCORE) | (langid.gram_count("text") < ENOUGH_GRAMS))).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@_others_apart
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join (sets of 5-word shingles, Jaccard similarity 0.8 or more) the smallest doc_id stays."""
    groups = jaccard_join.jaccard_components(docs, width=5, similarity=Fraction(4, 5))
    gone = materialize(groups.where("not kept").select("doc_id").distinct(), "near-copies")
    kept = docs.join(small(gone), "doc_id", "left_anti")
    twice = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.limit(1).count():  # rows that share a key are one document: the first by text, then by the other columns, stays
        order = [F.to_json("_others") if c == "_others" else F.col(c) for c in ["text", *(c for c in kept.columns if c not in ("doc_id", "text"))]]
        many = kept.join(small(twice), "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
        kept = kept.join(small(twice), "doc_id", "left_anti").unionByName(many.where("_n = 1").drop("_n"))
    return kept.select(*docs.columns)


@_others_apart
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that an earlier document also has; what is left without a word leaves.

    A character that the cut breaks goes with it."""
    cut = suffix_dedup.remove_repeats(docs, width=50)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).when(F.contains("text", F.lit("�")), text).otherwise(F.replace(text, F.lit("�"), F.lit("")))
    out = cut.withColumn("text", text).where((F.col("n_removed") == 0) | (mixing.word_count("text") > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_others_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks (weights 3, 1, 2 in turn, 150 % of all words, at most twice a source)."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 token ids in as few sequences as best-fit finds, with their ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express n-gram filters, byte suffixes or a tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
