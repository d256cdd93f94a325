"""As-of joins of two large sides, and ancestor tables by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def asof_join(facts: DataFrame, periods: DataFrame, key: Sequence[str], at: str, since: str, values: Sequence[str], until: str | None = None, slices: int = 64) -> DataFrame:
    """facts with the values of the period of their key that was in force at their own time: the last one that began by then (nulls before the first, and where it has ended).

    Both sides are one sorted union with a running last value, so no row meets more than one other. A key's rows are dealt by time into `slices` of equal length, so that a key which holds most facts is many
    groups; each slice begins with what was in force before it. Periods of one key that begin at the same time: the one of the largest values counts. A period that begins later ends the ones before. Facts
    without a key or time have null values; repeated facts stay; an empty side is fine. Existing columns of those names are replaced."""
    keep = [c for c in facts.columns if c not in values]
    moment = lambda c: F.col(c).cast("timestamp").cast("double")
    lo, hi = facts.agg(F.min(moment(at)), F.max(moment(at))).first()
    width = max((hi - lo) / slices, 1e-6) if lo is not None else 1.0
    # periods before all facts lie in slice -1, those behind all of them in the last one
    slice_ = lambda c: F.least(F.greatest(F.floor((moment(c) - F.lit(lo or 0.0)) / F.lit(width)), F.lit(-1)), F.lit(slices)).cast("int")
    p = periods.where(F.col(since).isNotNull()).groupBy(*key, since).agg(F.max(F.struct(*([until] if until else []), *values)).alias("v"))
    p = p.select(*key, F.col(since).cast("timestamp").alias("_at"), slice_(since).alias("_slice"), F.struct(since, "v.*").alias("_v"))
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    rows = facts.select(*keep, F.col(at).cast("timestamp").alias("_at"), F.when(known & F.col(at).isNotNull(), slice_(at)).alias("_slice"))
    # what is in force where a slice with facts begins: the last period of an earlier slice; a row for each key and slice
    marks = rows.where("_slice is not null").select(*key, "_slice").distinct()
    ends = p.groupBy(*key, "_slice").agg(F.max_by("_v", "_at").alias("_v"))
    carried = ends.withColumn("mark", F.lit(False)).unionByName(marks.withColumns({"_v": F.lit(None).cast(ends.schema["_v"].dataType), "mark": F.lit(True)}))
    # of its own slice a mark must see nothing: marks come first there
    first = Window.partitionBy(*key).orderBy("_slice", F.col("mark").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("_v", F.when(F.col("mark"), F.last("_v", ignorenulls=True).over(first))).where("mark and _v is not null")
    none = lambda c: F.lit(None).cast(facts.schema[c].dataType).alias(c)
    extra = [c for c in keep if c not in key]
    blank = [none(c) for c in extra]
    kind = lambda n: F.lit(n).alias("_kind")
    dtype = ends.schema["_v"].dataType
    parts = [
        carried.select(*key, *blank, F.lit(None).cast("timestamp").alias("_at"), "_slice", "_v", kind(0)),
        p.join(marks, [*key, "_slice"], "left_semi").select(*key, *blank, "_at", "_slice", "_v", kind(1)),
        rows.where("_slice is not null").select(*key, *extra, "_at", "_slice", F.lit(None).cast(dtype).alias("_v"), kind(2)),
    ]
    w = Window.partitionBy(*key, "_slice").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 2")
    lost = rows.where("_slice is null").select(*key, *extra, F.lit(None).cast(dtype).alias("_v"), "_at")
    out = met.select(*key, *extra, "_v", "_at").unionByName(lost)
    on = F.lit(True) if until is None else F.col("_v")[until].isNull() | (F.col("_at") < F.col("_v")[until].cast("timestamp"))
    return out.select(*keep, *(F.when(on, F.col("_v")[c]).alias(c) for c in values))


def ancestors(tree: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(code, ancestor, depth) of all codes of a tree (code, parent_code), each its own ancestor at depth 0, in twice as many joins as the depth has binary digits.

    Jumps of 1, 2, 4, ... steps are joined to themselves, and each doubles the depths that are known; rounds are written to the shared folder. A parent that is no code is an ancestor all the same; repeated rows count
    once; a code with two parents has the ancestors of both; a circle ends at `most` steps."""
    edges = tree.where("code is not null and parent_code is not null").select("code", F.col("parent_code").alias("ancestor")).distinct()
    jump = stored(edges.withColumn("depth", F.lit(1)), "jumps")
    known, reach = jump, 1
    while reach < most and jump.limit(1).count():
        far = known.select(F.col("code").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        on = lambda side, over: side.join(over, "ancestor").select("code", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        both = known.unionByName(on(jump, far)).where(F.col("depth") <= most).distinct()
        further = on(jump, jump.select(F.col("code").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))).distinct()
        known, jump, reach = stored(both, "ancestors"), stored(further, "jumps"), 2 * reach
    own = tree.where("code is not null").select("code").distinct()
    return own.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("depth")).unionByName(known)
