"""Catalogs and small relations: classification codes from XML or JSON, dated thresholds, tables of a namespace."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (key, from, until, value) of the rules' thresholds, by period.
THRESHOLDS = (
    ("da_ceiling_goods_services", "2016-05-26", "2023-01-01", "132519"), ("da_ceiling_goods_services", "2023-01-01", None, "270120"),
    ("da_ceiling_works", "2016-05-26", "2023-01-01", "441730"), ("da_ceiling_works", "2023-01-01", None, "900400"),
    ("da_max_plausible", "2016-01-01", None, "2000000"), ("da_rapid_hours", "2016-01-01", None, "0.1667"),
    ("da_conc_top_pct", "2016-01-01", None, "0.6"), ("da_conc_min_suppliers", "2016-01-01", None, "3"), ("da_conc_min_total", "2016-01-01", None, "100000"),
    ("da_dep_top_pct", "2016-01-01", None, "0.85"), ("da_dep_min_total", "2016-01-01", None, "50000"), ("da_split_min_count", "2016-01-01", None, "3"),
    ("da_round_floor_pct", "2016-01-01", None, "0.9"), ("da_year_end_share", "2016-01-01", None, "0.35"), ("da_year_end_min_total", "2016-01-01", None, "100000"),
)


def thresholds(spark: SparkSession, rows=THRESHOLDS) -> DataFrame:
    day = lambda s: datetime.fromisoformat(s) if s else None
    return spark.createDataFrame([(k, day(a), day(b), Decimal(v)) for k, a, b, v in rows], "key string, valid_from timestamp, valid_to timestamp, value_num decimal(18,4)")


def cpv_xml(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a classification in XML: CPV elements with a CODE and TEXT elements by LANG; Romanian, else English, else the code."""
    raw = spark.read.format("xml").option("rowTag", "CPV").schema("_CODE string, TEXT array<struct<_LANG: string, _VALUE: string>>").load(path)
    said = lambda lang: F.try_element_at(F.filter("TEXT", lambda t: t["_LANG"] == lang), F.lit(1))["_VALUE"]
    return raw.where("_CODE is not null").select(F.col("_CODE").alias("code"), F.coalesce(said("RO"), said("EN"), F.col("_CODE")).alias("name"))


def cpv_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("code string, name string").option("multiLine", True).json(path)


def tables(spark: SparkSession, namespace: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(namespace))


def tree_rows(roots: DataFrame) -> DataFrame:
    """(code, parent_code, level, total, n_children) of nested nodes (_id, total, children as JSON text), to any depth: one explode a level,
    until a level has no children."""
    node = "array<struct<_id: string, total: double, children: string>>"
    step = roots.select(F.col("_id").alias("code"), F.lit(None).cast("string").alias("parent_code"), "total", F.from_json("children", node).alias("c"))
    out, level = None, 0
    while True:
        rows = step.select("code", "parent_code", F.lit(level).alias("level"), "total", F.size(F.coalesce("c", F.array().cast(node))).alias("n_children"))
        out = rows if out is None else out.unionByName(rows)
        if not step.where(F.size("c") > 0).limit(1).count():
            return out
        level += 1
        step = step.select(F.col("code").alias("parent_code"), F.explode("c").alias("x")).select(F.col("x._id").alias("code"), "parent_code", F.col("x.total").alias("total"), F.from_json("x.children", node).alias("c"))


def key_difference(names: list[str], keep: list[str]) -> list[str]:
    """The names to clear: all but those to keep, in order."""
    return sorted(set(names) - set(keep))


def reset(spark: SparkSession, namespaces: list[str], keep: list[str]) -> list[str]:
    """Empty every table of the namespaces but those named in keep; returns what was emptied. Tables stay, with their schemas."""
    cleared = [f"{n}.{t}" for n in namespaces for t in key_difference(tables(spark, n), keep)]
    for name in cleared:
        spark.sql(f"TRUNCATE TABLE {name}")
    return cleared


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A small dimension after an upsert: new rows replace old ones with their key (null-safe), other old rows stay. Both have the same columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_new").alias("r"))
    return best.select(*key, *(F.col("r")[c].alias(c) for c in rest))
