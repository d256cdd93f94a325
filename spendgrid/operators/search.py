"""Organisation search: a token table, and ranked look-ups by equality, prefix and small edit distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_text


def documents(profile: DataFrame) -> DataFrame:
    """One row for each organisation of profile (entity_id, role, name, code, county, total): roles, totals by role, their maximum."""
    amount = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("total"))), F.lit(0.0))
    d = profile.groupBy("entity_id", "name", "code", "county").agg(F.array_sort(F.collect_set("role")).alias("roles"), amount("supplier").alias("supplier_total"), amount("authority").alias("authority_total"))
    return d.withColumn("total", F.greatest("supplier_total", "authority_total"))


def tokens(docs: DataFrame) -> DataFrame:
    """(token, entity_id, attribute): folded words of names (0) and codes (1); write it sorted by token for pruned look-ups."""
    words = lambda c: F.filter(F.split(fold_text(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    name = docs.select("entity_id", F.lit(0).alias("attribute"), F.explode(words("name")).alias("token"))
    return name.unionByName(docs.select("entity_id", F.lit(1).alias("attribute"), F.explode(words("code")).alias("token"))).distinct()


def _allowed(word):
    """Typos that a word may have: two from 9 letters on, one from 5."""
    return F.when(F.length(word) >= 9, 2).when(F.length(word) >= 5, 1).otherwise(0)


def _shorter(t):
    """Every string that a letter less makes of a token."""
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))


def _neighbours(t, deletions):
    """A token and what up to `deletions` (0 to 2) letters less make of it: strings within so many typos share one of them."""
    one = F.when(F.length(t) > 1, _shorter(t)).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 1, _shorter(x)).otherwise(F.array().cast("array<string>"))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(t), F.when(deletions >= 1, one).otherwise(none), F.when(deletions >= 2, two).otherwise(none)))


def typo_keys(index: DataFrame) -> DataFrame:
    """(key, token): the distinct tokens by what deletions make of them; write it sorted by key. A token is only given the deletions that some
    query word of about its length may need."""
    return index.select("token").distinct().select("token", F.explode(_neighbours(F.col("token"), F.when(F.length("token") >= 7, 2).when(F.length("token") >= 4, 1).otherwise(0))).alias("key"))


def write_index(profile: DataFrame, folder: str) -> None:
    """Write the documents, tokens and typo keys of profile as tables sorted by what look-ups ask for."""
    docs = documents(profile)
    docs.write.mode("overwrite").parquet(f"{folder}/documents")
    index = tokens(docs)
    for name, table, key in (("tokens", index, "token"), ("typos", typo_keys(index), "key")):
        table.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/{name}")


def search_index(spark: SparkSession, folder: str, query: str, limit: int = 30, role: str | None = None) -> DataFrame:
    """search() over the tables of write_index()."""
    docs, index, typos = (spark.read.parquet(f"{folder}/{x}") for x in ("documents", "tokens", "typos"))
    return search(docs, index, query, limit, role, typos)


def search(docs: DataFrame, index: DataFrame, query: str, limit: int = 30, role: str | None = None, typos: DataFrame | None = None) -> DataFrame:
    """Hits of a query: all its words (the last one as a prefix), one typo from 5 letters on, two from 9; most words first, then fewest
    typos, names before codes, then id and name. A blank query has no hits.

    Exact words, the prefix and (with typos, a table of typo_keys()) misspelt words are equality and range look-ups, which a sorted table answers
    from a few of its row groups; without typos the keys are made of the whole index."""
    spark, words = docs.sparkSession, query.split()
    if not words:
        return docs.limit(0)
    # the words of one query: a handful
    q = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, raw string").select("i", fold_text(F.col("raw")).alias("w"))
    last = q.where(F.col("i") == len(words) - 1).first()["w"]
    exact = index.join(F.broadcast(q), F.col("token") == F.col("w")).select("i", "w", "token", F.lit(0).alias("typos"))
    begun = index.where(F.col("token").startswith(last)).select(F.lit(len(words) - 1).alias("i"), F.lit(last).alias("w"), "token", F.lit(0).alias("typos"))
    keys = q.withColumn("key", F.explode(_neighbours(F.col("w"), _allowed("w")))).where(_allowed("w") > 0)
    near = (typo_keys(index) if typos is None else typos).join(F.broadcast(keys), "key").select("i", "w", "token").distinct()
    near = near.select("i", "w", "token", F.levenshtein("token", "w").alias("typos")).where(F.col("typos") <= _allowed("w"))
    found = exact.unionByName(begun).unionByName(near).groupBy("i", "w", "token").agg(F.min("typos").alias("typos"))
    hits = index.join(found, "token")
    best = hits.groupBy("entity_id", "i").agg(F.min(F.struct("typos", "attribute", (F.col("token") != F.col("w")).alias("inexact"))).alias("b"))
    ranked = best.groupBy("entity_id").agg(F.count("*").alias("words"), F.sum("b.typos").alias("typos"), F.min("b.attribute").alias("attribute"), F.sum(F.col("b.inexact").cast("int")).alias("inexact"))
    out = docs.join(ranked, "entity_id")
    if role:
        out = out.where(F.array_contains("roles", role))
    return out.orderBy(F.desc("words"), "typos", "attribute", "inexact", "entity_id", "name").limit(limit)
