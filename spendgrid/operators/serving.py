"""Read queries over the marts: each takes DataFrames and parameters and gives a DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import gap_minutes, minute_text
from ..functions.text import county_key

SORTS = {"date": ("finalization", False), "value": ("closing", False), "gap": ("gap_minutes", True)}


def digits_only(value: str) -> int:
    """An id from a request; anything but digits is id 0, which nothing has."""
    return int(value) if value.isascii() and value.isdigit() else 0


def headline(totals: DataFrame, kinds: list[str]) -> DataFrame:
    """One row: the all-time count and sum of each kind."""
    return totals.where("all_time = 1").groupBy().agg(*(x for k in kinds for x in (F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"{k}_n"), F.max(F.when(F.col("kind") == k, F.col("total"))).alias(f"{k}_total"))))


def largest(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), *ties).limit(k)


def children(tree: DataFrame, parent: str | None) -> DataFrame:
    """Nodes below a code (the roots for None) that carry money, largest first."""
    return tree.where(F.col("parent_code").eqNullSafe(F.lit(parent)) & (F.col("total") > 0)).orderBy(F.desc("total"), "code")


def node(tree: DataFrame, code: str) -> DataFrame:
    return tree.where(F.col("code") == code)


def ancestry(tree: DataFrame, codes: DataFrame, hops: int = 6) -> DataFrame:
    """(code, ancestor, depth) from each code up to its root, the code itself at depth 0; at most `hops` steps up."""
    edges = tree.select(F.col("code").alias("_c"), "parent_code")
    step = codes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("depth"))
    out = step
    for depth in range(1, hops + 1):
        step = step.join(edges, F.col("ancestor") == F.col("_c")).where("parent_code is not null").select("code", F.col("parent_code").alias("ancestor"), F.lit(depth).alias("depth"))
        out = out.unionByName(step)
    return out


def transactions(da: DataFrame, organisations: DataFrame, codes: Column) -> DataFrame:
    """Acquisitions (da_id, …) with names, county, minute texts, gap and sorted flag codes (null if none).

    codes: the flags of an acquisition, which follow from its own row, so no flag is joined back."""
    side = lambda role, p: organisations.where(F.col("role") == role).select(F.col("entity_id").alias(p + "_id"), F.col("name").alias(p + "_name"), *([F.col("county")] if role == "authority" else []))
    out = da.withColumn("da_flags", codes).join(side("authority", "authority"), "authority_id", "left").join(side("supplier", "supplier"), "supplier_id", "left")
    return out.withColumns({"gap_minutes": gap_minutes(F.col("publication"), F.col("finalization")), "publication": minute_text(F.col("publication")), "finalization": minute_text(F.col("finalization"))})


def entity_flags(index: DataFrame, names: DataFrame, entity: str) -> DataFrame:
    """An organisation's index in each of its roles with its name and county, most flags first; an id that is not all digits has none."""
    own = index.where(F.col("entity_id") == digits_only(entity)).join(names, ["entity_id", "role"], "left")
    return own.select("role", "name", "county", "cri", F.size("codes").alias("n_flags"), F.col("n").alias("n_das"), "total", "codes").orderBy(F.desc("n_flags"), F.desc("n_das"), "role")


def coverage(totals: DataFrame, shapes: DataFrame) -> DataFrame:
    """(key, label, total, coverage) of map shapes (key, label) by the county totals (county, total) whose folded name is their key.

    Shapes without money have 0; coverage is the percentage of all money that lands on a shape, the same in each row."""
    folded = totals.groupBy(county_key(F.col("county")).alias("key")).agg(F.sum("total").alias("total"))
    whole = folded.agg(F.sum("total").alias("whole"))
    on = shapes.join(folded, "key", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    mapped = on.agg(F.sum("total").alias("mapped"))
    share = F.when(F.col("whole") > 0, F.col("mapped") / F.col("whole") * 100).otherwise(0.0)
    return on.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(mapped)).select("key", "label", "total", share.alias("coverage"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): how many rows each table has, one aggregate a table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def report(counts: DataFrame) -> str:
    """A job's row counts (name, n: one row a table) as one JSON object."""
    return json.dumps({r["name"]: r["n"] for r in counts.orderBy("name").collect()})


def entity_transactions(table: DataFrame, entity: int, role: str, sort: str = "date", year: str | None = None, flag: str | None = None, page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(page, total) of an organisation's transactions; absent parameters do not filter."""
    cond: Column = F.col(f"{role}_id") == entity
    if year:
        cond = cond & F.col("finalization").startswith(year)
    if flag:
        cond = cond & F.array_contains("da_flags", flag)
    column, up = SORTS[sort]
    hits = table.where(cond)
    order = F.asc_nulls_last(column) if up else F.desc_nulls_last(column)
    return hits.orderBy(order, "da_id").offset((page - 1) * size).limit(size), hits.agg(F.count("*").alias("total"))


def entity_partners(da: DataFrame, entity: int, role: str, k: int = 12, bound: float = 2_000_000) -> DataFrame:
    """The largest counterparties of an organisation and their share of its total."""
    other = "supplier_id" if role == "authority" else "authority_id"
    own = da.where((F.col(f"{role}_id") == entity) & (F.col("closing") <= bound))
    per = own.groupBy(F.col(other).alias("partner_id")).agg(F.count("*").alias("n"), F.sum("closing").alias("total"))
    whole = own.agg(F.sum("closing").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).withColumn("share", F.col("total").cast("double") / F.nullif(F.col("whole").cast("double"), F.lit(0.0))).orderBy(F.desc("total"), "partner_id").limit(k)


def monthly(da: DataFrame, bound: float) -> DataFrame:
    return da.where((F.col("closing") <= bound) & F.col("finalization").isNotNull()).groupBy(F.date_format("finalization", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("closing").alias("total"))


def split_pairs(flags: DataFrame, entity: str, role: str, k: int = 30) -> DataFrame:
    """The split flags of an organisation with the numbers of their evidence."""
    own = "subject_id" if role == "authority" else "partner_id"
    get = lambda path, kind: F.nullif(F.get_json_object("evidence", path), F.lit("")).try_cast(kind)
    return flags.where((F.col("flag_code") == "da_split") & (F.col(own) == entity)).select("subject_id", "partner_id", get("$.year", "int").alias("year"), get("$.count", "long").alias("n"), get("$.total", "double").alias("total"), get("$.ceiling", "double").alias("ceiling")).orderBy(F.desc_nulls_last("total"), "subject_id", "partner_id", "year").limit(k)


def risk_leaders(index: DataFrame, role: str, k: int = 25, least: dict[str, int] | None = None) -> DataFrame:
    least = least or {"authority": 30, "supplier": 10}
    return index.where((F.col("role") == role) & (F.col("n") >= least[role]) & (F.col("cri") > 0)).orderBy(F.desc("cri"), F.desc_nulls_last("total"), "entity_id").limit(k)


def flag_instances(instances: DataFrame, code: str, k: int = 50) -> DataFrame:
    return instances.where(F.col("flag_code") == code).orderBy(F.desc_nulls_last("total"), F.desc_nulls_last("severity"), "authority_id", "supplier_id", "period").limit(k)


def profile_with_rank(profile: DataFrame, tops: DataFrame) -> DataFrame:
    return profile.join(tops.select("entity_id", "role", "rank"), ["entity_id", "role"], "left")


def quantile_bounds(values: DataFrame, column: str, classes: int = 5, cells: int = 256) -> DataFrame:
    """One row: the nearest-rank bounds between classes of a column (an array of classes - 1 values, or fewer if values are few).

    Exact without one sort of all values: equal values are counted first, approximate quantiles deal the distinct ones into cells of about equal
    weight, the few cells are summed, and values are ranked within their cells only."""
    known = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    cuts = known.agg(F.percentile_approx("v", [k / cells for k in range(1, cells)], F.lit(40 * cells))).first()[0] or []
    cell = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(cuts)))), lambda x: x < F.col("v"))) if cuts else F.lit(0)
    counted = known.groupBy("v").agg(F.count("*").alias("n")).withColumn("cell", cell)
    sums = counted.groupBy("cell").agg(F.sum("n").alias("weight"))  # at most `cells` rows
    sums = sums.selectExpr("cell", "sum(weight) over (order by cell) - weight as before", "sum(weight) over () as total")
    ranked = counted.join(F.broadcast(sums), "cell").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("cell").orderBy("v")))
    picks = [F.min(F.when(F.col("upto") >= F.floor(F.lit(k) * F.col("total") / classes) + 1, F.col("v"))) for k in range(1, classes)]
    return ranked.agg(F.array_compact(F.array(*picks)).alias("bounds"))


def class_of(value: Column, bounds: Column) -> Column:
    """How many bounds lie strictly below a value."""
    return F.size(F.filter(bounds, lambda b: value > b))
