"""Mixing sources to target weights: sizes by source, repetition rates, then floor(rate) copies and a hash-seeded one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source, null among them.

    Sources by code point, null last, take the weights in turn. Targets share `share` of all words by weight; none
    passes cap * source_size, and what is cut off is shared again by weight until nothing is above: in order of
    cap per weight, a source is cut if its cap is at most the level that all sources after it would reach."""
    cycle = F.array(*map(F.lit, weights))
    w = sizes.withColumn("i", F.expr("row_number() over (order by source asc nulls last)"))
    w = w.withColumn("weight", F.element_at(cycle, F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("double"))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("turn", F.col("most") / F.col("weight"))
    w = w.withColumns(
        {
            "before": F.expr("coalesce(sum(most) over (order by turn, i rows between unbounded preceding and 1 preceding), 0D)"),
            "left": F.expr("sum(weight) over (order by turn, i rows between current row and unbounded following)"),
            "total": F.expr("sum(source_size) over ()") * F.lit(float(share)),
        }
    )
    w = w.withColumn("cut", F.col("turn") * F.col("left") <= F.col("total") - F.col("before"))
    w = w.withColumns({"spent": F.expr("coalesce(sum(case when cut then most end) over (), 0D)"), "rest": F.expr("sum(case when not cut then weight end) over ()")})
    target = F.when(F.col("cut"), F.col("most")).otherwise((F.col("total") - F.col("spent")) * F.col("weight") / F.col("rest"))
    return w.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 11, **targets) -> DataFrame:
    """All rows of docs with size, source_size, target (its source's), rate and copies.

    copies is floor(rate) plus 1 if a number in [0, 1) made of the first 52 bits of an MD5 of seed, key and text is below the
    rate's fraction; so reruns agree and no row is taken more than ceil(rate) times. A source without words has target and rate 0.
    Null texts have size 0; null sources form a source; rows that agree in key and text decide alike; an empty table
    gives an empty result. Existing columns of these names are replaced."""
    names = ["size", "source_size", "target", "rate", "copies"]
    base = docs.drop(*names).withColumn("size", word_count(text))
    sizes = base.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    t = materialize(source_targets(sizes, **targets), "targets").withColumnRenamed("source", "_source")
    joined = base.join(small(t), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(text)))
    draw = F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", rate).withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as often as mix_plan() says, with the columns of docs."""
    plan = mix_plan(docs, **options).where("copies > 0")
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
