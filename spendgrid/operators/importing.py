"""The dump path: dimensions and acquisitions of an old export, resolved in bulk, and marts from its pre-summed totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.catalogs import tree_rows

# How the export writes parties ("5002142 Name" and "33264530 NAME") and the largest number that can be a source id.
AUTHORITY_PARTY = r"(?U)^([0-9]+)\s+(.*)$"
SUPPLIER_PARTY = r"(?U)^(\S+)\s+(.*)$"
INT32_MAX = 2_147_483_647


def money(c: Column) -> Column:
    """A number with two decimals, half up; what is no number counts as 0. Ties follow the number's shortest decimal form."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.round(F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x).cast("decimal(38,9)"), 2).cast("decimal(28,2)")


def whole_number(c: Column) -> Column:
    """A finite number's whole part as a long, null for anything else."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 9.2e18), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).cast("long")


def code_key(code: Column) -> Column:
    return F.concat(F.lit("code:"), code)


def id_key(namespace: str, source_id: Column) -> Column:
    return F.concat(F.lit(f"id:{namespace}:"), source_id.cast("string"))


def load_entities(dimension: DataFrame, namespace: str) -> DataFrame:
    """(namespace, source_id, entity_key, code, code_valid, name, normalized, legal_form, county, code_raw) of a dimension (ord, _id, cui, name, county).

    Rows whose id is no number are left out; of several rows with one id the first by ord counts. Ids with one valid fiscal code are one
    organisation, whatever their namespace; its attributes are those of its first row, see entities()."""
    source = whole_number(F.col("_id"))
    d = dimension.withColumn("source_id", source).where("source_id is not null")
    d = d.groupBy("source_id").agg(F.min_by(F.struct("ord", "cui", "name", "county"), "ord").alias("r")).select("source_id", "r.*")
    code = X.fiscal_code(F.col("cui"))
    valid = X.fiscal_code_valid(code)
    name = F.coalesce(X.blank_to_null(X.trim_wide(F.col("name"))), F.lit(X.NO_NAME))
    key = F.when(valid, code_key(code)).otherwise(id_key(namespace, F.col("source_id")))
    return d.select(
        F.lit(namespace).alias("namespace"), "ord", "source_id", key.alias("entity_key"), F.when(valid, code).alias("code"), valid.alias("code_valid"), name.alias("name"),
        X.normalized_name(name).alias("normalized"), X.legal_form(name).alias("legal_form"), "county", F.col("cui").alias("code_raw"),
    )


def entities(*links: DataFrame) -> DataFrame:
    """One row for each organisation of load_entities() results, the first file's and then the first row's attributes winning."""
    out = None
    for i, df in enumerate(links):
        one = df.withColumn("_file", F.lit(i))
        out = one if out is None else out.unionByName(one)
    rest = ["code", "code_valid", "name", "normalized", "legal_form", "county", "code_raw"]
    g = out.groupBy("entity_key").agg(F.min_by(F.struct(*rest), F.struct("_file", "ord")).alias("r"), F.count("*").alias("n_ids"))
    return g.select("entity_key", "r.*", "n_ids")


def load_acquisitions(dump: DataFrame, links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Acquisitions of a dump (ord, directAcquisitionId, uniqueIdentificationCode, contractingAuthority, supplier, cpvCode, estimatedValueRon,
    closingValue, publicationDate, finalizationDate, state) with the keys of their parties; the first row by ord of each id counts, rows without
    a number as id are left out.

    An authority's leading number is a source id if it fits 32 bits (looked up in links: namespace, source_id, entity_key), else a fiscal code if
    that is valid; a supplier's first word is a fiscal code if valid. What has neither is one organisation for each string as written, and a string of
    another shape names none."""
    d = dump.withColumn("da_id", whole_number(F.col("directAcquisitionId"))).where("da_id is not null")
    rest = [c for c in d.columns if c != "da_id"]
    d = d.groupBy("da_id").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("da_id", "r.*")
    raw = {s: F.coalesce(F.col(c), F.lit("")) for s, c in (("authority", "contractingAuthority"), ("supplier", "supplier"))}
    token = {s: X.blank_to_null(F.regexp_extract(X.trim_wide(raw[s]), p, 1)) for s, p in (("authority", AUTHORITY_PARTY), ("supplier", SUPPLIER_PARTY))}
    number = token["authority"].try_cast("decimal(38,0)")
    d = d.withColumn("_source", F.when((number > 0) & (number <= INT32_MAX), number).cast("long"))
    known = links.where("namespace = 'authority'").select(F.col("source_id").alias("_source"), F.col("entity_key").alias("_linked"))
    d = d.join(known, "_source", "left")

    # one step for each, as an expression that holds a code as often as its check reads it grows beyond what is compiled
    d = d.withColumns({f"_token_{s}": token[s] for s in raw})
    d = d.withColumns({f"_own_{s}": X.fiscal_code(F.col(f"_token_{s}")) for s in raw})
    d = d.withColumns({f"_valid_{s}": X.fiscal_code_valid(F.col(f"_own_{s}")) for s in raw})

    def by_code(side: str) -> Column:
        return F.when(F.col(f"_valid_{side}"), code_key(F.col(f"_own_{side}"))).when(F.col(f"_token_{side}").isNotNull(), F.concat(F.lit("raw:"), F.sha2(raw[side], 256)))

    authority = F.coalesce("_linked", id_key("authority", F.col("_source")), by_code("authority"))
    code = X.cpv_code(F.col("cpvCode"))
    d = d.withColumns({"authority_key": authority, "supplier_key": by_code("supplier"), "_code": code, "cpv_raw": F.col("cpvCode")})
    d = d.join(catalog.select(F.col("code").alias("_known")).distinct(), F.col("_code") == F.col("_known"), "left")
    stamp = lambda c: F.try_to_timestamp(F.col(c))
    amount = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).try_cast("decimal(18,2)")
    return d.select(
        "da_id", F.col("uniqueIdentificationCode").alias("da_code"), "authority_key", "supplier_key", F.col("_known").alias("cpv_code"), F.when(F.nullif("cpv_raw", F.lit("")).isNotNull(), F.col("_known").isNotNull()).alias("cpv_valid"), "cpv_raw",
        amount("estimatedValueRon").alias("estimated"), amount("closingValue").alias("closing"), stamp("publicationDate").alias("publication"), stamp("finalizationDate").alias("finalization"), "state",
    )


def load_report(dump: DataFrame, loaded: DataFrame, known: DataFrame) -> DataFrame:
    """One row: seen, inserted, authority_misses and supplier_misses (organisations that only the acquisitions name), cpv_invalid."""
    new = lambda s: loaded.select(F.col(f"{s}_key").alias("entity_key")).where("entity_key is not null").distinct().join(known.select("entity_key").distinct(), "entity_key", "left_anti").agg(F.count("*").alias(f"{s}_misses"))
    counts = loaded.agg(F.count("*").alias("inserted"), F.count_if(F.col("cpv_valid").eqNullSafe(F.lit(False))).alias("cpv_invalid"))
    # four aggregates of one row each
    return dump.agg(F.count("*").alias("seen")).crossJoin(counts).crossJoin(new("authority")).crossJoin(new("supplier"))


def profiles_from_totals(totals: DataFrame, links: DataFrame, role: str) -> DataFrame:
    """(entity_key, role, total) of pre-summed totals (source_id, total): source ids become organisations, and those that are one add up. Ids that no link knows are left out."""
    t = totals.select(whole_number(F.col("source_id")).alias("source_id"), F.coalesce(F.col("total").try_cast("double"), F.lit(0.0)).cast("decimal(28,6)").alias("total")).where("source_id is not null")
    per = t.groupBy("source_id").agg(F.sum("total").alias("total"))
    mine = links.where(F.col("namespace") == role).select("source_id", "entity_key")
    return per.join(mine, "source_id").groupBy("entity_key").agg(F.round(F.sum("total"), 2).cast("decimal(28,2)").alias("total")).select("entity_key", F.lit(role).alias("role"), "total")


def by_type_all(totals: DataFrame) -> DataFrame:
    """(kind 'all', acquisition_type, total) of totals (_id, total)."""
    return totals.select(F.lit("all").alias("kind"), F.col("_id").cast("string").alias("acquisition_type"), money(F.col("total")).alias("total"))


def by_division_all(roots: DataFrame) -> DataFrame:
    """(kind 'all', division, name, total) of a tree's roots (_id, description, total); roots whose code does not start with two digits are left out."""
    code = F.col("_id").cast("string")
    return roots.where(code.rlike("^[0-9]{2}")).select(F.lit("all").alias("kind"), F.left(code, F.lit(2)).alias("division"), F.col("description").alias("name"), money(F.col("total")).alias("total"))


def national_all(profiles: DataFrame, totals: DataFrame) -> DataFrame:
    """(kind, n, total): how many suppliers and authorities have a profile, and all spend; no year."""
    none = F.lit(None).cast("decimal(28,2)")
    out = None
    for role in ("supplier", "authority"):
        one = profiles.where(F.col("role") == role).agg(F.count("*").alias("n")).select(F.lit(role).alias("kind"), "n", none.alias("total"))
        out = one if out is None else out.unionByName(one)
    spend = totals.agg(F.sum(F.coalesce(F.col("total").try_cast("double"), F.lit(0.0)).cast("decimal(28,6)")).alias("t"))
    return out.unionByName(spend.select(F.lit("spend").alias("kind"), F.lit(0).cast("long").alias("n"), F.round(F.coalesce("t", F.lit(0)), 2).cast("decimal(28,2)").alias("total")))


def tree(roots: DataFrame) -> DataFrame:
    """cpv_tree rows of nested roots whose code starts with two digits, the roots at level 1."""
    rows = tree_rows(roots.where(F.col("_id").rlike("^[0-9]{2}")))
    return rows.withColumns({"level": F.col("level") + 1, "total": money(F.col("total"))})
