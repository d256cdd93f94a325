"""The silver build and the dump path over payloads and dumps made of the driver's tables, and the read queries that belong to them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import minute_text
from ..functions.text import external_number
from ..functions import text as X
from ..operators import asof, flags, importing, merge, normalize, resolution, serving, silver, sinks
from ..session import shared_folder, stored
from ..sources import bson, catalogs, paged, versioned
from ..sources.views import MONEY, Views
from ..streaming import cursors
from .registry import DA, LIMITS, ORGS, half_up_sql, query
from .relational import dbl
from .risk import _CRI, _CRI_VALUE, _OWN, _da, _names

c = F.col
lit = F.lit


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else lit(p) for p in parts))


def _checked(code: str) -> str:
    """SQL that tells whether a code of 2 to 10 digits ends in its check digit."""
    d = lambda i: f"CAST(substr(lpad({code}, 10, '0'), {i}, 1) AS INT)"
    return f"((7 * {d(1)} + 5 * {d(2)} + 3 * {d(3)} + 2 * {d(4)} + 1 * {d(5)} + 7 * {d(6)} + 5 * {d(7)} + 3 * {d(8)} + 2 * {d(9)}) * 10 % 11 % 10 = {d(10)})"


def _catalog(v: Views) -> DataFrame:
    return v.spark.createDataFrame([("45000000-7",), ("15800000-6",)], "code string")


def _units(v: Views) -> DataFrame:
    return v.spark.createDataFrame([("bucata", "buc", 1.0), ("kg", "kg", 1.0)], "pattern string, unit string, factor double")


def _raw(rows: DataFrame, kind: str, raw_id: Column, payload: Column) -> DataFrame:
    return rows.select(raw_id.cast("long").alias("raw_id"), lit(kind).alias("endpoint_version"), payload.alias("payload"))


def _tenders(v: Views) -> DataFrame:
    """Events as tender lists: every third in two versions, some without a key, some broken."""
    e = v.table("events").select("*", F.explode(F.array(lit(0), lit(1))).alias("k")).where("k = 0 or event_id % 3 = 0")
    i = c("event_id")
    cpv = F.when(i % 4 == 0, "45000000-7 - Works").when(i % 4 == 1, "99999999-9 - Other").when(i % 4 == 2, "not a cpv")
    label = lambda x: F.struct(x.alias("text"))
    body = F.struct(
        F.when(i % 50 != 7, i).alias("cNoticeId"), _text("N", i).alias("noticeNo"), _text("RO", c("user_id") + 100, " - Org ", c("user_id")).alias("contractingAuthorityNameAndFN"), cpv.alias("cpvCodeAndName"),
        (c("value").cast(MONEY) + c("k")).cast(MONEY).alias("estimatedValueRon"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("noticeStateDate"), label(c("event_type")).alias("sysNoticeState"), lit(True).alias("isOnline"), lit("kept out").alias("unknownField"),
    )
    return _raw(e, "tender-list:v1", i * 2 + c("k"), F.when(i % 50 == 8, "{broken").otherwise(F.to_json(body)))


def _award_contracts(v: Views) -> DataFrame:
    """Orders as the contracts of a customer's award, customers with even keys in two versions; winners are the suppliers of the lines."""
    s = c("l_suppkey")
    who = F.struct(s.alias("entityId"), _text("RO", s + 100).alias("fiscalNumber"), F.when(s % 2 == 0, _text("Supplier ", s)).alias("name"), F.when(s % 2 == 1, F.struct(_text("Supplier ", s).alias("officialName"))).alias("address"))
    w = v.table("lineitem").select(c("l_orderkey").alias("o"), who.alias("w"), s.alias("s")).dropDuplicates(["o", "s"]).groupBy("o").agg(F.collect_list("w").alias("w"))
    o = v.table("orders").join(w, c("o_orderkey") == c("o"), "left").select("*", F.explode(F.array(lit(0), lit(1))).alias("k")).where("k = 0 or o_custkey % 2 = 0")
    price = c("o_totalprice").cast(MONEY)
    item = F.struct(
        c("o_orderkey").alias("caNoticeContractId"), (c("o_custkey") + c("k")).alias("caNoticeId"), F.when(c("k") == 0, "first").otherwise("second").alias("contractTitle"), price.alias("contractValue"),
        F.when(c("o_orderkey") % 2 == 0, (price + 1).cast(MONEY)).alias("defaultCurrencyContractValue"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("contractDate"), F.struct(lit("RON").alias("text")).alias("currency"),
        F.when(F.size("w") > 1, c("w")).alias("winners"), F.when(F.size("w") == 1, F.element_at("w", 1)).alias("winner"),
    )
    g = o.groupBy("o_custkey", "k").agg(F.to_json(F.struct(c("o_custkey").alias("caNoticeId"), F.collect_list(item).alias("items"))).alias("payload"))
    return _raw(g, "award-contracts:v1", c("o_custkey") * 2 + c("k"), c("payload"))


#: An item's id in the payloads is its order's key times this plus its part's key: wider than any part's key, so that no two items share an id.
_ITEMS = 1 << 32


def _acquisitions(v: Views) -> DataFrame:
    """Orders as acquisition lists, those with even keys also as details with their lines as items."""
    o, k, price = v.table("orders"), c("o_orderkey"), c("o_totalprice").cast(MONEY)
    both = {"uniqueIdentificationCode": _text("DA", k), "publicationDate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "sysDirectAcquisitionState": F.struct(c("o_orderstatus").alias("text"))}
    named = lambda **x: F.to_json(F.struct(*(e.alias(n) for n, e in x.items())))
    first = named(directAcquisitionId=k, contractingAuthority=_text("RO", c("o_custkey") + 100, " - Customer ", c("o_custkey")), supplier=_text("S.C. Furnizor ", c("o_custkey") % 50), cpvCode=F.when(k % 3 == 0, "45000000-7 - Works").when(k % 3 == 1, "99999999-9 - Other"), closingValue=price, **both)
    lines = v.table("lineitem").where("l_orderkey % 2 = 0").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum(c("l_extendedprice").cast(MONEY)).alias("p"))
    p = c("l_partkey")
    item = F.struct(
        (c("l_orderkey") * _ITEMS + p).alias("directAcquisitionItemID"), _text("Part ", p).alias("catalogItemName"), c("q").cast("decimal(18,4)").alias("itemQuantity"), F.when(p % 3 == 0, "Bucată").when(p % 3 == 1, "  BUCATA ").otherwise("palet").alias("itemMeasureUnit"), c("p").alias("itemClosingPrice"),
        F.struct(lit("15800000-6 - Food").alias("text"), F.when(p % 2 == 0, "45000000-7").alias("localeKey")).alias("cpvCode"),
    )
    items = lines.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    d = o.where("o_orderkey % 2 = 0").join(items, c("o_orderkey") == c("l_orderkey"), "left")
    second = named(directAcquisitionID=k, contractingAuthorityID=F.when(k % 10 == 0, 999).otherwise(c("o_custkey") + 1000), cpvCode=F.struct(F.when(k % 3 == 0, "45000000-7").alias("localeKey")), closingValue=(price + 5).cast(MONEY), sysAcquisitionContractType=F.struct(c("o_orderpriority").alias("text")), directAcquisitionItems=c("items"), **both)
    return _raw(o, "da-list:v1", k * 2, first).unionByName(_raw(d, "da-detail:v1", k * 2 + 1, second))


def _named_by(rows: DataFrame, silver: normalize.Silver, column: str, name: str) -> DataFrame:
    o = silver.tables["organisations"].select(c("entity_id").alias(column), c("name").alias(name), c("code").alias(f"{name}_code"))
    return rows.join(o, column, "left")


_RIGHT = "event_id % 50 NOT IN (7, 8)"
_USER = "CAST(user_id + 100 AS VARCHAR)"


@query("normalize_notices", f"SELECT event_id AS notice_id, 'N' || event_id AS notice_no, CASE WHEN event_id % 4 = 0 THEN '45000000-7' END AS cpv_code, CASE WHEN event_id % 4 <> 3 THEN event_id % 4 = 0 END AS cpv_valid, CASE event_id % 4 WHEN 0 THEN '45000000-7 - Works' WHEN 1 THEN '99999999-9 - Other' WHEN 2 THEN 'not a cpv' END AS cpv_raw, CAST(CAST(value AS DECIMAL(18,2)) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value, event_type AS state, strftime(ts, '%Y-%m-%d %H:%M') AS at, 'Org ' || user_id AS org, CASE WHEN {_checked(_USER)} THEN {_USER} END AS org_code FROM events WHERE {_RIGHT}")
def normalize_notices(v: Views) -> DataFrame:
    s = normalize.normalize(_tenders(v), _catalog(v), _units(v), "tender-list:v1")
    n = _named_by(s.tables["notices"], s, "authority_id", "org")
    return n.select("notice_id", "notice_no", "cpv_code", "cpv_valid", "cpv_raw", dbl("value"), "state", minute_text(c("state_date")).alias("at"), "org", "org_code")


@query("normalize_quarantine", "SELECT event_id * 2 + k AS raw_id, CASE event_id % 50 WHEN 7 THEN 'no cNoticeId' ELSE 'payload is no JSON' END AS reason FROM events, range(2) r(k) WHERE event_id % 50 IN (7, 8) AND (k = 0 OR event_id % 3 = 0)")
def normalize_quarantine(v: Views) -> DataFrame:
    return normalize.normalize(_tenders(v), _catalog(v), _units(v), "tender-list:v1").quarantine.select("raw_id", "reason")


@query("normalize_report", "SELECT 'tender-list:v1' AS endpoint_version, count(*) FILTER (WHERE event_id % 50 NOT IN (7, 8)) AS processed, count(*) FILTER (WHERE event_id % 50 IN (7, 8)) AS quarantined, max(event_id * 2 + k) AS cursor, CAST(0 AS BIGINT) AS pending FROM events, range(2) r(k) WHERE k = 0 OR event_id % 3 = 0")
def normalize_report(v: Views) -> DataFrame:
    """Counts and cursor of a run, and what a second run would find behind the cursor."""
    raw = _tenders(v)
    s = normalize.normalize(raw, _catalog(v), _units(v), "tender-list:v1")
    left = normalize.pending(raw, s.cursors).agg(F.count("*").alias("pending"))
    return s.report.join(s.cursors, "endpoint_version").crossJoin(F.broadcast(left)).select("endpoint_version", "processed", "quarantined", "cursor", "pending")


@query("normalize_contracts", "SELECT o_orderkey AS contract_id, o_custkey AS ca_notice_id, CASE WHEN o_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS title, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value, 'RON' AS currency, strftime(o_orderdate, '%Y-%m-%d') AS at, o_custkey * 2 + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS raw_id FROM orders")
def normalize_contracts(v: Views) -> DataFrame:
    t = normalize.normalize(_award_contracts(v), _catalog(v), _units(v), "award-contracts:v1").tables["contracts"]
    return t.select("contract_id", "ca_notice_id", "title", dbl("value"), "currency", F.date_format("contract_date", "yyyy-MM-dd").alias("at"), "raw_id")


@query("normalize_winners", "SELECT DISTINCT l_orderkey AS contract_id, 'Supplier ' || l_suppkey AS winner FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def normalize_winners(v: Views) -> DataFrame:
    s = normalize.normalize(_award_contracts(v), _catalog(v), _units(v), "award-contracts:v1")
    return _named_by(s.tables["contract_winners"], s, "supplier_id", "winner").select("contract_id", "winner")


_EVEN = "o_orderkey % 2 = 0"


@query("normalize_acquisitions", f"SELECT o_orderkey AS da_id, 'Customer ' || o_custkey AS authority, 'S.C. Furnizor ' || (o_custkey % 50) AS supplier, CASE WHEN o_orderkey % 3 = 0 THEN '45000000-7' END AS cpv_code, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN {_EVEN} THEN 5 ELSE 0 END AS DOUBLE) AS closing, CASE WHEN {_EVEN} THEN o_orderpriority END AS acquisition_type, o_orderstatus AS state, o_orderkey * 2 + CASE WHEN {_EVEN} THEN 1 ELSE 0 END AS raw_id FROM orders")
def normalize_acquisitions(v: Views) -> DataFrame:
    s = normalize.normalize(_acquisitions(v), _catalog(v), _units(v))
    a = _named_by(_named_by(s.tables["acquisitions"], s, "authority_id", "authority"), s, "supplier_id", "supplier")
    return a.select("da_id", "authority", "supplier", "cpv_code", dbl("closing"), "acquisition_type", "state", "raw_id")


@query("normalize_items", "SELECT l_orderkey * 100000 + l_partkey AS item_id, l_orderkey AS da_id, 'Part ' || l_partkey AS name, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CASE l_partkey % 3 WHEN 0 THEN 'Bucată' WHEN 1 THEN '  BUCATA ' ELSE 'palet' END AS unit_raw, CASE WHEN l_partkey % 3 < 2 THEN 'buc' END AS unit, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CASE WHEN l_partkey % 2 = 0 THEN '45000000-7' ELSE '15800000-6' END AS cpv_code FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey, l_partkey")
def normalize_items(v: Views) -> DataFrame:
    """Items under the SQL's numbers, which two acquisitions may share once a part's key has six digits; so they are made from the items' ids at the end."""
    t = normalize.normalize(_acquisitions(v), _catalog(v), _units(v)).tables["items"]
    part = c("item_id") - c("da_id") * _ITEMS
    return t.select((c("da_id") * 100_000 + part).alias("item_id"), "da_id", "name", dbl("quantity"), "unit_raw", "unit", dbl("price"), "cpv_code")


@query("normalize_source_ids", "SELECT 'authority' AS namespace, id AS source_id, 'Customer ' || arg_min(o_custkey, o_orderkey) AS organisation FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 999 ELSE o_custkey + 1000 END AS id FROM orders WHERE o_orderkey % 2 = 0) GROUP BY id")
def normalize_source_ids(v: Views) -> DataFrame:
    s = normalize.normalize(_acquisitions(v), _catalog(v), _units(v))
    return _named_by(s.tables["source_ids"], s, "entity_id", "organisation").select("namespace", "source_id", "organisation")


@query("entity_resolution", f"WITH o AS (SELECT *, CAST(entity_id + 100 AS VARCHAR) AS code FROM {ORGS}), m AS (SELECT *, {_checked('code')} AS ok, entity_id * 2 + CASE WHEN role = 'supplier' THEN 1 ELSE 0 END AS ord FROM o) SELECT CASE WHEN ok THEN 'code:' || code ELSE 'id:' || role || ':' || entity_id END AS entity_key, CASE WHEN bool_or(ok) THEN min(code) END AS code, bool_or(ok) AS code_valid, arg_min(name, ord) AS name, arg_min(county, ord) AS county, CAST(count(DISTINCT entity_id) AS INT) AS ids FROM m GROUP BY 1")
def entity_resolution(v: Views) -> DataFrame:
    o = v.organisations
    m = o.select((c("entity_id") * 2 + (c("role") == "supplier").cast("int")).alias("ord"), c("role").alias("namespace"), c("entity_id").alias("source_id"), _text("RO", c("entity_id") + 100).alias("code_raw"), "name", "county", lit(None).cast("timestamp").alias("seen_at"))
    organisations, _ = silver.resolve_organisations(m)
    return organisations.select("entity_key", "code", "code_valid", "name", "county", F.size("source_ids").alias("ids"))


# ---------------------------------------------------------------- the dump path


def _dimension(v: Views, role: str) -> DataFrame:
    o = v.organisations.where(c("role") == role)
    return o.select(c("entity_id").alias("ord"), c("entity_id").cast("string").alias("_id"), _text("RO", c("entity_id") + 100).alias("cui"), c("name"), c("county"))


def _links(v: Views) -> tuple[DataFrame, DataFrame]:
    return importing.load_entities(_dimension(v, "supplier"), "supplier"), importing.load_entities(_dimension(v, "authority"), "authority")


_ENTITIES = f"(SELECT role AS namespace, entity_id AS source_id, name, county, CASE WHEN {_checked('CAST(entity_id + 100 AS VARCHAR)')} THEN 'code:' || (entity_id + 100) ELSE 'id:' || role || ':' || entity_id END AS entity_key FROM {ORGS})"


@query("import_entities", f"SELECT entity_key, arg_min(name, CASE namespace WHEN 'supplier' THEN 0 ELSE 1 END) AS name, arg_min(county, CASE namespace WHEN 'supplier' THEN 0 ELSE 1 END) AS county, count(*) AS n_ids FROM {_ENTITIES} GROUP BY 1")
def import_entities(v: Views) -> DataFrame:
    return importing.entities(*_links(v)).select("entity_key", "name", "county", "n_ids")


def _totals(v: Views) -> tuple[DataFrame, DataFrame]:
    s = v.table("lineitem").groupBy(c("l_suppkey").cast("string").alias("source_id"), "l_returnflag").agg(F.sum(c("l_extendedprice").cast(MONEY)).cast("double").alias("total"))
    a = v.table("orders").groupBy(c("o_custkey").cast("string").alias("source_id"), "o_orderpriority").agg(F.sum(c("o_totalprice").cast(MONEY)).cast("double").alias("total"))
    return s.select("source_id", "total"), a.select("source_id", "total")


def _profiles(v: Views) -> DataFrame:
    (s, a), (ls, la) = _totals(v), _links(v)
    return importing.profiles_from_totals(s, ls, "supplier").unionByName(importing.profiles_from_totals(a, la, "authority"))


_IMPORTED = f"""(SELECT e.entity_key, t.role, sum(t.total) AS total FROM (SELECT 'supplier' AS role, l_suppkey AS id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 2
 UNION ALL SELECT 'authority', o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders GROUP BY 2) t JOIN {_ENTITIES} e ON e.namespace = t.role AND e.source_id = t.id GROUP BY 1, 2)"""


@query("import_profiles", f"SELECT p.entity_key, p.role, CAST(p.total AS DOUBLE) AS total, n.name FROM {_IMPORTED} p LEFT JOIN (SELECT entity_key, arg_min(name, CASE namespace WHEN 'supplier' THEN 0 ELSE 1 END) AS name FROM {_ENTITIES} GROUP BY 1) n USING (entity_key)")
def import_profiles(v: Views) -> DataFrame:
    names = importing.entities(*_links(v)).select("entity_key", "name")
    return _profiles(v).join(names, "entity_key", "left").select("entity_key", "role", dbl("total"), "name")


def _types(v: Views) -> DataFrame:
    return v.table("orders").groupBy(c("o_orderpriority").alias("_id")).agg(F.sum(c("o_totalprice").cast(MONEY)).cast("double").alias("total"))


@query("import_by_type", "SELECT 'all' AS kind, o_orderpriority AS acquisition_type, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 2 ORDER BY total DESC")
def import_by_type(v: Views) -> DataFrame:
    t = importing.by_type_all(_types(v))
    return serving.largest(t.where("kind = 'all'"), "total", 100, "acquisition_type").select("kind", "acquisition_type", dbl("total"))


def _roots(v: Views) -> DataFrame:
    """A tree of codes: sizes (two digits) over brands over types, with a root whose code is no number."""
    p = v.table("part").select((c("p_size") % 40 + 10).cast("string").alias("t"), "p_brand", "p_type", c("p_retailprice").cast(MONEY).alias("x"))
    leaf = p.groupBy("t", "p_brand", "p_type").agg(F.sum("x").alias("x"))
    node = lambda code, kids: F.struct(code.alias("_id"), c("x").cast("double").alias("total"), kids.alias("children"))
    ends = F.collect_list(node(_text(c("t"), "-", c("p_brand"), "-", c("p_type")), F.array().cast("array<string>")))
    mid = leaf.groupBy("t", "p_brand").agg(ends.alias("kids"), F.sum("x").alias("s")).withColumnRenamed("s", "x")
    top = mid.groupBy("t").agg(F.to_json(F.collect_list(node(_text(c("t"), "-", c("p_brand")), c("kids")))).alias("children"), F.sum("x").cast("double").alias("total"))
    roots = top.select(c("t").alias("_id"), _text("division ", c("t")).alias("description"), "total", "children")
    return roots.unionByName(v.spark.createDataFrame([("SEAP", "all of it", 1.0, None)], "_id string, description string, total double, children string"))


_PARTS = "(SELECT CAST(p_size % 40 + 10 AS VARCHAR) AS t, p_brand AS b, p_type AS y, CAST(p_retailprice AS DECIMAL(18,2)) AS x FROM part)"
_TREE = f"""(SELECT t AS code, NULL AS parent_code, 1 AS level, CAST(sum(x) AS DOUBLE) AS total, CAST(count(DISTINCT b) AS INT) AS n_children FROM {_PARTS} GROUP BY t
 UNION ALL SELECT t || '-' || b, t, 2, CAST(sum(x) AS DOUBLE), CAST(count(DISTINCT y) AS INT) FROM {_PARTS} GROUP BY t, b
 UNION ALL SELECT t || '-' || b || '-' || y, t || '-' || b, 3, CAST(sum(x) AS DOUBLE), 0 FROM {_PARTS} GROUP BY t, b, y)"""


@query("import_by_division", f"SELECT 'all' AS kind, code AS division, 'division ' || code AS name, total FROM {_TREE} WHERE level = 1 ORDER BY total DESC, division LIMIT 15")
def import_by_division(v: Views) -> DataFrame:
    return serving.largest(importing.by_division_all(_roots(v)), "total", 15, "division").select("kind", "division", "name", dbl("total"))


@query("import_tree", f"SELECT * FROM {_TREE}")
def import_tree(v: Views) -> DataFrame:
    return importing.tree(_roots(v)).select("code", "parent_code", "level", dbl("total"), "n_children")


@query("tree_children", f"SELECT code, total, level FROM {_TREE} WHERE parent_code IS NOT DISTINCT FROM '12' AND total > 0 UNION ALL SELECT code, total, level FROM {_TREE} WHERE parent_code IS NULL AND total > 0")
def tree_children(v: Views) -> DataFrame:
    """The nodes below a code and the roots."""
    t = importing.tree(_roots(v))
    return serving.children(t, "12").unionByName(serving.children(t, None)).select("code", dbl("total"), "level")


@query("tree_node", f"SELECT code, parent_code, total FROM {_TREE} WHERE code = '12'")
def tree_node(v: Views) -> DataFrame:
    return serving.node(importing.tree(_roots(v)), "12").select("code", "parent_code", dbl("total"))


@query("catalog_files", "SELECT CAST(n_nationkey + 10000000 AS VARCHAR) || '-1' AS code, CASE n_nationkey % 3 WHEN 0 THEN n_name || ' ro' WHEN 1 THEN n_name || ' & en' ELSE CAST(n_nationkey + 10000000 AS VARCHAR) || '-1' END AS xml_name, n_name AS json_name FROM nation")
def catalog_files(v: Views) -> DataFrame:
    """A catalog written as XML and as JSON to the shared folder and read back: Romanian names, else English ones, else the code."""
    folder = f"{shared_folder(v.spark)}/catalog-{uuid.uuid4().hex}"
    n = v.table("nation").withColumn("code", _text(c("n_nationkey") + 10_000_000, "-1"))
    said = lambda lang, text: F.struct(lit(lang).alias("_LANG"), text.alias("_VALUE"))
    k, ro, en, de = c("n_nationkey") % 3, said("RO", _text(c("n_name"), " ro")), said("EN", _text(c("n_name"), " & en")), said("DE", c("n_name"))
    n.select(c("code").alias("_CODE"), F.when(k == 0, F.array(en, ro)).when(k == 1, F.array(en, de)).otherwise(F.array(de, de)).alias("TEXT")).write.format("xml").option("rootTag", "CPVS").option("rowTag", "CPV").save(f"{folder}/xml")
    n.select("code", c("n_name").alias("name")).write.json(f"{folder}/json")
    x, j = catalogs.cpv_xml(v.spark, f"{folder}/xml"), v.spark.read.schema("code string, name string").json(f"{folder}/json")
    return x.withColumnRenamed("name", "xml_name").join(j.withColumnRenamed("name", "json_name"), "code").orderBy("code")


@query("upsert_dimension", "SELECT key, CAST(period AS BIGINT) AS period, value FROM (SELECT p_brand AS key, p_size AS period, CASE WHEN bool_or(p_type = 'PROMO') THEN 'new' ELSE 'old' END AS value FROM part GROUP BY 1, 2)")
def upsert_dimension(v: Views) -> DataFrame:
    p = v.table("part").select(c("p_brand").alias("key"), c("p_size").cast("long").alias("period"), "p_type")
    old = p.select("key", "period").distinct().withColumn("value", lit("old"))
    return catalogs.upsert(old, p.where("p_type = 'PROMO'").select("key", "period").distinct().withColumn("value", lit("new")), ["key", "period"])


@query("rewrite_scrubbed", r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email redactat]', 'g')) AS digest FROM documents")
def rewrite_scrubbed(v: Views) -> DataFrame:
    """Texts rewritten in place of old ones, with the check that nothing is left that had to go."""
    docs = v.table("documents").select("doc_id", "text")
    done = sinks.rewrite(docs, lambda d: d.withColumn("text", X.scrub_emails(c("text"))), c("text").rlike(X.EMAIL))
    return done.select("doc_id", F.md5("text").alias("digest"))


@query("import_national", f"SELECT role AS kind, count(*) AS n, CAST(NULL AS DOUBLE) AS total FROM {_IMPORTED} GROUP BY 1 UNION ALL SELECT 'spend', 0, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders")
def import_national(v: Views) -> DataFrame:
    return importing.national_all(_profiles(v), _types(v)).select("kind", "n", dbl("total"))


def _dump(v: Views) -> DataFrame:
    """Orders as acquisitions of a dump, each in two rows of which the first counts, with parties written in every way."""
    o = v.table("orders").select("*", F.explode(F.array(lit(0), lit(1))).alias("k"))
    i, cust = c("o_orderkey"), c("o_custkey")
    authority = F.when(i % 5 == 0, _text(cust, " Customer ", cust)).when(i % 5 == 1, _text("99999999999 Big ", cust % 3)).when(i % 5 == 2, "no number").when(i % 5 == 3, _text(" ", cust + 1_000_000, "  New ")).otherwise("4000000016 Large code")
    supplier = F.when(i % 3 == 0, _text("RO", cust + 100, " NAME")).when(i % 3 == 1, "oneword").otherwise("XX12 FOO")
    return o.select(
        (i * 2 + c("k")).alias("ord"), F.when(i % 11 == 3, "abc").otherwise(_text(i, ".5")).alias("directAcquisitionId"), _text("DA", i).alias("uniqueIdentificationCode"), authority.alias("contractingAuthority"), supplier.alias("supplier"),
        F.when(i % 4 == 0, "45000000-7 Works").when(i % 4 == 1, "99999999-9 Other").when(i % 4 == 2, "").alias("cpvCode"), lit("").alias("estimatedValueRon"), (c("o_totalprice").cast(MONEY) + c("k")).cast("string").alias("closingValue"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("publicationDate"), lit("not a date").alias("finalizationDate"), c("o_orderstatus").alias("state"),
    )


_LOADED = f"""(SELECT o_orderkey AS da_id, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_custkey > 0 THEN e.entity_key ELSE 'raw:' || sha256('0 Customer 0') END WHEN 1 THEN 'raw:' || sha256('99999999999 Big ' || (o_custkey % 3)) WHEN 3 THEN 'id:authority:' || (o_custkey + 1000000) WHEN 4 THEN CASE WHEN {_checked("'4000000016'")} THEN 'code:4000000016' ELSE 'raw:' || sha256('4000000016 Large code') END END AS authority_key,
 CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN {_checked('CAST(o_custkey + 100 AS VARCHAR)')} THEN 'code:' || (o_custkey + 100) ELSE 'raw:' || sha256('RO' || (o_custkey + 100) || ' NAME') END WHEN 2 THEN 'raw:' || sha256('XX12 FOO') END AS supplier_key,
 CASE WHEN o_orderkey % 4 = 0 THEN '45000000-7' END AS cpv_code, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 4 = 0 END AS cpv_valid, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS closing, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS publication
 FROM orders LEFT JOIN {_ENTITIES} e ON e.namespace = 'authority' AND e.source_id = o_custkey WHERE o_orderkey % 11 <> 3)"""


@query("import_acquisitions", f"SELECT * FROM {_LOADED}")
def import_acquisitions(v: Views) -> DataFrame:
    t = importing.load_acquisitions(_dump(v), _links(v)[1], _catalog(v))
    return t.select("da_id", "authority_key", "supplier_key", "cpv_code", "cpv_valid", dbl("closing"), minute_text(c("publication")).alias("publication"))


@query("import_report", f"SELECT (SELECT count(*) * 2 FROM orders) AS seen, (SELECT count(*) FROM {_LOADED}) AS inserted, (SELECT count(*) FROM {_LOADED} WHERE cpv_valid = false) AS cpv_invalid, (SELECT count(DISTINCT authority_key) FROM {_LOADED} WHERE authority_key NOT IN (SELECT entity_key FROM {_ENTITIES})) AS authority_misses, (SELECT count(DISTINCT supplier_key) FROM {_LOADED} WHERE supplier_key NOT IN (SELECT entity_key FROM {_ENTITIES})) AS supplier_misses")
def import_report(v: Views) -> DataFrame:
    dump, links = _dump(v), _links(v)
    loaded = stored(importing.load_acquisitions(dump, links[1], _catalog(v)), "loaded")
    return importing.load_report(dump, loaded, links[0].select("entity_key").unionByName(links[1].select("entity_key")))


# ---------------------------------------------------------------- reading


@query("top_divisions", f"SELECT division, total FROM (SELECT division, CAST(sum(closing) AS DOUBLE) AS total FROM {DA} GROUP BY 1) ORDER BY total DESC, division LIMIT 3")
def top_divisions(v: Views) -> DataFrame:
    return serving.largest(v.acquisitions.groupBy("division").agg(F.sum("closing").cast("double").alias("total")), "total", 3, "division")


@query("entity_flags", f"SELECT c.role, o.name, o.county, c.cri, CAST(len(c.codes) AS INT) AS n_flags, c.n AS n_das, c.total, array_to_string(c.codes, ',') AS codes FROM (SELECT *, {_CRI_VALUE} AS cri FROM {_CRI}) c LEFT JOIN {ORGS} o ON o.entity_id = c.entity_id AND o.role = c.role WHERE c.entity_id = 7")
def entity_flags(v: Views) -> DataFrame:
    out = serving.entity_flags(flags.risk_index(v.acquisitions, LIMITS), v.organisations, "7")
    return out.select("role", "name", "county", "cri", "n_flags", "n_das", dbl("total"), F.array_join("codes", ",").alias("codes"))


@query("flag_lines", f"SELECT authority_id, CAST(round(total) AS BIGINT) AS whole, line FROM (SELECT CAST(authority_id AS VARCHAR) AS authority_id, total, CAST(CAST(floor(CAST(round(CAST(top / total AS DECIMAL(28,12)), 4) AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || '% · ' || suppliers AS line FROM (SELECT authority_id, CAST(sum(part) AS DOUBLE) AS total, count(*) AS suppliers, CAST(max(part) AS DOUBLE) AS top FROM (SELECT authority_id, supplier_id, sum(closing) AS part FROM {DA} WHERE closing <= 100000 GROUP BY 1, 2) GROUP BY 1) WHERE total >= 100000 AND suppliers >= 3 AND top / total >= CAST(0.10 AS DOUBLE)) ORDER BY total DESC, authority_id LIMIT 50")
def flag_lines(v: Views) -> DataFrame:
    """The fifty largest concentrations with the figures of their evidence lines."""
    da = _da(v)
    top = serving.flag_instances(flags.instances(flags.all_flags(da, LIMITS), da, _names(v)), "da_concentration", 50)
    line = flags.evidence_line(c("flag_code"), c("evidence"))
    parts = F.concat(F.regexp_extract(line, "^top furnizor ([0-9]+%)", 1), lit(" · "), F.regexp_extract(line, " ([0-9]+) furnizori$", 1))
    return top.select("authority_id", F.round("total").cast("long").alias("whole"), parts.alias("line"))


@query("flag_acquisitions", f"SELECT code AS flag_code, authority_id, supplier_id, total FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY severity DESC, da_id) AS i FROM (SELECT 'da_round' AS code, da_id, CAST(authority_id AS VARCHAR) AS authority_id, CAST(supplier_id AS VARCHAR) AS supplier_id, CAST(closing AS DOUBLE) AS total, CAST(closing AS DOUBLE) / (CASE WHEN division = 'PROMO' THEN CAST(95000 AS DOUBLE) ELSE CAST(80000 AS DOUBLE) END) AS severity FROM {DA} WHERE closing > 0 AND closing <= 100000) WHERE severity >= CAST(0.9 AS DOUBLE) AND severity < 1) WHERE i <= 500")
def flag_acquisitions(v: Views) -> DataFrame:
    """The acquisitions among the browsable flags: the 500 that come closest below their ceiling."""
    da = _da(v)
    got = flags.instances(flags.all_flags(da, LIMITS), da, _names(v))
    return got.where("subject_type = 'da' and flag_code = 'da_round'").select("flag_code", "authority_id", "supplier_id", "total")


@query("county_coverage", f"WITH t AS (SELECT upper(n_name) AS county, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT lower(n_name) AS key, n_name AS label, coalesce(t.total, 0) AS total FROM nation LEFT JOIN t ON lower(t.county) = lower(n_name) WHERE n_nationkey < 20) SELECT key, label, total, {half_up_sql('(SELECT sum(total) FROM s) / (SELECT sum(total) FROM t) * 100', 4)} AS coverage FROM s")
def county_coverage(v: Views) -> DataFrame:
    """Totals of all nations on a map that has twenty of them."""
    n = v.table("nation")
    t = v.table("customer").join(n, c("c_nationkey") == c("n_nationkey")).groupBy(F.upper("n_name").alias("county")).agg(F.sum(c("c_acctbal").cast(MONEY)).cast("double").alias("total"))
    out = serving.coverage(t, n.where("n_nationkey < 20").select(F.lower("n_name").alias("key"), c("n_name").alias("label")))
    return out.withColumn("coverage", F.round(c("coverage").cast("decimal(28,12)"), 4).cast("double"))


@query("row_counts", f"SELECT 'acquisitions' AS name, count(*) AS n FROM {DA} UNION ALL SELECT 'contracts', count(*) FROM orders UNION ALL SELECT 'notices', count(*) FROM events UNION ALL SELECT 'flags', count(*) FROM ({_OWN})")
def row_counts(v: Views) -> DataFrame:
    own = flags.all_flags(_da(v), LIMITS).where("subject_type <> 'da'")
    return serving.row_counts({"acquisitions": v.acquisitions, "contracts": v.contracts, "notices": v.notices, "flags": own})


@query("published_version", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def published_version(v: Views) -> DataFrame:
    """A mart published twice, read as a reader finds it: the second version whole."""
    folder, o = f"{shared_folder(v.spark)}/mart-{uuid.uuid4().hex}", v.table("orders").select(c("o_orderstatus").alias("status"))
    for rows in (o.where("status = 'F'"), o):
        sinks.publish(rows.groupBy("status").agg(F.count("*").alias("n")), folder)
    return sinks.published(v.spark, folder)


@query("archive_append", "SELECT batch, CAST(sum(seen) AS BIGINT) AS inserted, CAST(sum(twice) AS BIGINT) AS skipped, (SELECT count(*) FROM events) AS stored FROM (SELECT 'first' AS batch, CASE WHEN event_id % 3 < 2 THEN 1 ELSE 0 END AS seen, 0 AS twice FROM events UNION ALL SELECT 'second', CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END, CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END FROM events) GROUP BY 1")
def archive_append(v: Views) -> DataFrame:
    """Two batches that overlap, appended to an archive by content hash: what each inserted and skipped, and what is stored in the end."""
    path = f"{shared_folder(v.spark)}/archive-{uuid.uuid4().hex}"
    rows = v.table("events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "props")), 256).alias("content_hash"))
    told = [(name, sinks.append_new(rows.where(cond), path, ["content_hash"])) for name, cond in (("first", "event_id % 3 < 2"), ("second", "event_id % 3 > 0"))]
    counts = v.spark.createDataFrame([(n, t["inserted"], t["skipped"]) for n, t in told], "batch string, inserted long, skipped long")
    return counts.crossJoin(v.spark.read.parquet(path).agg(F.count("*").alias("stored")))


@query("cursor_commits", "SELECT strftime(TIMESTAMP '2024-01-01' + to_days(CAST(8 * k AS INT)), '%Y-%m-%d') AS day, count(*) AS n, '2024-02-02' AS following FROM (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) // 8 AS INT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-02') GROUP BY k")
def cursor_commits(v: Views) -> DataFrame:
    """A window read in chunks of eight days, each committed with its cursor, the second one twice as after a crash."""
    folder, e = f"{shared_folder(v.spark)}/window-{uuid.uuid4().hex}", v.table("events").select("event_id", F.to_date("ts").alias("d"))
    for i, (a, b) in enumerate(cursors.chunks("2024-01-01", "2024-02-01", 8)):
        at, end = cursors.Cursor("2024-01-01", a), cursors.Cursor("2024-01-01", b).after_day()
        for _ in range(2 if i == 1 else 1):
            cursors.commit(e.where(c("d").between(a, b)), folder, "events", at, end)
    last = cursors.read_cursor(v.spark, folder, "events")
    day = F.regexp_extract("batch", "^([0-9-]+)-day", 1)
    return cursors.committed(v.spark, folder).groupBy(day.alias("day")).agg(F.count("*").alias("n")).withColumn("following", lit(last.day))


@query("external_ids", "SELECT event_id AS notice_id, CASE WHEN event_id % 9 <> 4 THEN event_id END AS number FROM events")
def external_ids(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", F.when(c("event_id") % 9 == 4, _text("da:x", c("event_id"))).otherwise(_text("da:", c("event_id"))).alias("x"))
    return e.select(c("event_id").alias("notice_id"), external_number(c("x")).alias("number"))


@query("cursor_stream", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST((row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) - 1) // 200 AS INT) AS page, count(*) OVER (PARTITION BY date_trunc('day', ts)) AS reported FROM events")
def cursor_stream(v: Views) -> DataFrame:
    """The days of the events as a stream of paged lists, page by page under a cursor: the stream fails once between reading and committing, and a second one goes on
    where the first left its checkpoint."""
    folder, e = f"{shared_folder(v.spark)}/lists-{uuid.uuid4().hex}", v.table("events")
    day = F.date_format("ts", "yyyy-MM-dd")
    paged.record(e.select(day.alias("day"), c("event_id").alias("place"), F.to_json(F.struct("event_id", day.alias("at"))).alias("item")), f"{folder}/answers", 200)
    first, last, pages = e.agg(F.min(day), F.max(day), F.greatest(F.ceil(F.count("*") / 200 / 5), lit(8))).first()
    paged.register(v.spark)
    lists = v.spark.readStream.format("paged_list").options(url=f"{folder}/answers", start=first, end=last, dateField="at", pageSize="200", pagesPerTrigger=str(pages), progress=f"{folder}/progress").load()

    def drain(fail_at: int | None) -> None:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
            if number == fail_at:
                raise InterruptedError("between reading and committing")

        query_ = lists.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").start()
        try:
            query_.processAllAvailable()
        finally:
            query_.stop()

    try:
        drain(1)
    except Exception as failed:
        if "between reading and committing" not in str(failed):
            raise
    drain(None)
    out = v.spark.read.schema(f"{paged.COLUMNS}, batch int").parquet(f"{folder}/out")
    return out.select(F.get_json_object("item", "$.event_id").cast("long").alias("event_id"), "day", "page", "reported")


@query("bson_split", "SELECT event_id AS _id, user_id, event_type AS kind, value FROM events WHERE user_id >= 40 AND event_type IN ('view', 'click', 'error')")
def bson_split(v: Views) -> DataFrame:
    """The events as a dump of many files, cut at any bytes into ranges whose tasks agree on their documents, and read with conditions that no other row passes."""
    folder = f"{shared_folder(v.spark)}/dump-{uuid.uuid4().hex}"
    nested = F.struct(c("props"), F.array(c("value"), lit(1.5)).alias("list"))
    bson.write_dump(v.table("events").select(c("event_id").alias("_id"), "user_id", nested.alias("doc"), c("event_type").alias("kind"), "value"), f"{folder}/files")
    bson.split_dump(v.spark, f"{folder}/files", f"{folder}/ranges", chunk=1 << 18)
    bson.register(v.spark)
    dump = v.spark.read.format("bson_dump").schema("_id long, user_id long, kind string, value double").option("ranges", f"{folder}/ranges").load(f"{folder}/files")
    return dump.where("user_id >= 40 and kind in ('view', 'click', 'error')")


@query("archive_versions", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 1 ELSE 2 END AS version FROM events")
def archive_versions(v: Views) -> DataFrame:
    """Two batches of the events that overlap, appended to a transactional table by key, and a third that fails while it is written: the version that each event came with."""
    folder, e = f"{shared_folder(v.spark)}/versions-{uuid.uuid4().hex}", v.table("events").select("event_id", "user_id", "value")
    versioned.append_unique(e.where("event_id % 5 < 3"), folder, ["event_id"])
    versioned.append_unique(e.where("event_id % 5 > 0"), folder, ["event_id"])
    try:
        broken = e.select((c("event_id") + F.when(c("value").isNotNull(), F.raise_error(lit("broken")).cast("long"))).alias("event_id"), "user_id", "value")
        broken.write.format("versioned_table").mode("append").save(folder)
    except Exception:  # noqa: BLE001  (that it leaves nothing is the point)
        pass
    parts = [versioned.read_version(v.spark, folder, n, after=n - 1).select("event_id", lit(n).alias("version")) for n in range(1, versioned.latest_version(folder) + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("merged_acquisitions", f"SELECT o_orderkey AS da_id, CASE WHEN o_orderkey % 3 = 0 THEN '45000000-7' WHEN NOT ({_EVEN}) AND o_orderkey % 3 = 1 THEN '99999999-9' END AS cpv_code, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN {_EVEN} THEN 5 ELSE 0 END AS DOUBLE) AS closing, 'S.C. Furnizor ' || (o_custkey % 50) AS supplier, CASE WHEN {_EVEN} THEN o_orderpriority END AS acquisition_type, o_orderkey * 2 + CASE WHEN {_EVEN} THEN 1 ELSE 0 END AS raw_id FROM orders")
def merged_acquisitions(v: Views) -> DataFrame:
    """Acquisition lists and details in three batches, details first, one batch twice, merged on read over a base that was made after the second."""
    raw = stored(_acquisitions(v), "raw")
    rows = silver.acquisitions_of(silver.parsed(raw, "da-list:v1"), "da-list:v1").unionByName(silver.acquisitions_of(silver.parsed(raw, "da-detail:v1"), "da-detail:v1"))
    parts = {"header": ["cpv_code", "closing", "raw_id"], "parties": ["supplier"], "detail": ["acquisition_type"]}
    t = merge.MergedTable(v.spark, f"{shared_folder(v.spark)}/merged-{uuid.uuid4().hex}", ["da_id"], parts, ["turn"], buckets=8)
    rows = rows.withColumn("turn", c("raw_id"))
    sets = {"parties": c("kind") == "list", "detail": c("kind") == "detail"}
    batch = {"details": rows.where("kind = 'detail'"), "some": rows.where("kind = 'list' and da_id % 4 < 2"), "rest": rows.where("kind = 'list' and da_id % 4 >= 2")}
    for name in ("details", "some"):
        t.append(batch[name], name, sets)
    t.compact()
    for name in ("rest", "some"):
        t.append(batch[name], name, sets)
    return t.read().select("da_id", "cpv_code", dbl("closing"), "supplier", "acquisition_type", "raw_id")


_MENTIONS = f"(SELECT o_orderkey * 4 AS ord, 'authority' AS ns, o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'RO' || (o_custkey + 100) END AS raw, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey + 100 AS VARCHAR) END AS code, 'Customer ' || o_custkey AS name, CAST(o_orderdate AS DATE) AS seen FROM orders UNION ALL SELECT l_orderkey * 4 + 1, 'supplier', l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'RO ' || (l_suppkey + 100) END, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey + 100 AS VARCHAR) END, 'Supplier ' || l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem WHERE l_linenumber <= 2)"


@query("resolution_batches", f"WITH m AS (SELECT *, code IS NOT NULL AND {_checked('code')} AS ok FROM {_MENTIONS}), o AS (SELECT ns, id, bool_or(ok) AS owns, min(code) AS own FROM m GROUP BY ns, id), k AS (SELECT m.*, CASE WHEN owns THEN 'code:' || own ELSE 'id:' || ns || ':' || id END AS entity_key FROM m JOIN o USING (ns, id)) SELECT entity_key, bool_or(ok) AS code_valid, arg_min(name, ord) AS name, strftime(min(seen), '%Y-%m-%d') AS first_seen, strftime(max(seen), '%Y-%m-%d') AS last_seen, array_to_string(list_sort(list(DISTINCT id)), ',') AS source_ids, coalesce(array_to_string(list_sort(list(DISTINCT raw) FILTER (WHERE raw IS NOT NULL)), '|'), '') AS code_variants FROM k GROUP BY entity_key")
def resolution_batches(v: Views) -> DataFrame:
    """Organisations of order and line mentions, resolved in three batches that come in no order, with a base made in between: codes, names, days, ids and variants."""
    o, i = v.table("orders"), v.table("lineitem").where("l_linenumber <= 2")
    none = lit(None).cast("string")
    k, s = c("o_custkey"), c("l_suppkey")
    a = o.select((c("o_orderkey") * 4).alias("ord"), lit("authority").alias("namespace"), k.alias("source_id"), F.when(c("o_orderkey") % 3 == 0, _text("RO", k + 100)).alias("code_raw"), _text("Customer ", k).alias("name"), none.alias("county"), c("o_orderdate").cast("timestamp").alias("seen_at"))
    b = i.select((c("l_orderkey") * 4 + 1).alias("ord"), lit("supplier").alias("namespace"), s.alias("source_id"), F.when(c("l_linenumber") % 2 == 0, _text("RO ", s + 100)).alias("code_raw"), _text("Supplier ", s).alias("name"), none.alias("county"), c("l_shipdate").cast("timestamp").alias("seen_at"))
    m, r = a.unionByName(b), resolution.Resolution(v.spark, f"{shared_folder(v.spark)}/resolution-{uuid.uuid4().hex}", buckets=8)
    for turn in (2, 0, 1):
        r.append(m.where(F.floor(c("ord") / 4) % 3 == turn), f"batch {turn}")
        if turn == 0:
            r.compact()
    day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    return r.organisations().select("entity_key", "code_valid", "name", day("first_seen"), day("last_seen"), F.array_join(c("source_ids").cast("array<string>"), ",").alias("source_ids"), F.array_join("code_variants", "|").alias("code_variants"))


@query("asof_periods", "SELECT f.l_suppkey AS supplier_id, count(*) AS n, count(p.q) AS known, CAST(sum(p.q) AS DOUBLE) AS total FROM lineitem f ASOF LEFT JOIN (SELECT l_suppkey AS k, l_shipdate AS a, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) p ON f.l_suppkey = p.k AND f.l_shipdate >= p.a GROUP BY 1")
def asof_periods(v: Views) -> DataFrame:
    """Every line with the quantity that its supplier's last returned line by then set: two large sides, no range join."""
    lines = v.table("lineitem")
    periods = lines.where("l_returnflag = 'R'").select(c("l_suppkey").alias("supplier_id"), c("l_shipdate").alias("since"), c("l_quantity").alias("quantity"))
    facts = lines.select(c("l_suppkey").alias("supplier_id"), c("l_shipdate").alias("day"))
    t = asof.asof_join(facts, periods, ["supplier_id"], "day", "since", ["quantity"])
    return t.groupBy("supplier_id").agg(F.count("*").alias("n"), F.count("quantity").alias("known"), F.sum("quantity").cast("double").alias("total"))


@query("recorded_thresholds", "WITH t AS (SELECT o_orderpriority AS key, date_trunc('month', o_orderdate) AS a, max(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2) SELECT key, CAST(arg_max(v, a) AS DOUBLE) AS latest, CAST(max(v) FILTER (WHERE a = TIMESTAMP '1996-06-01') AS DOUBLE) AS june FROM t GROUP BY key")
def recorded_thresholds(v: Views) -> DataFrame:
    """Thresholds recorded month by month from the orders, written and read: the latest of each key, and the one in force on a day."""
    month = F.date_trunc("month", "o_orderdate")
    t = v.table("orders").groupBy(c("o_orderpriority").alias("key"), month.alias("valid_from")).agg(F.max(c("o_totalprice").cast(MONEY)).alias("value_num")).withColumn("valid_to", F.add_months("valid_from", 1).cast("timestamp"))
    t = stored(t, "thresholds")
    then = flags.thresholds_at(t, lit("1996-06-15").cast("timestamp")).select("key", dbl("value_num").alias("june"))
    return flags.thresholds_at(t).select("key", dbl("value_num").alias("latest")).join(then, "key", "left")


@query("ancestor_table", "WITH RECURSIVE t AS (SELECT 'u' || user_id || '-' || i AS code, CASE WHEN i > 0 THEN 'u' || user_id || '-' || (i // 2 * 2 - CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) END AS parent FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i < 40), up AS (SELECT code, code AS ancestor, 0 AS depth FROM t UNION ALL SELECT up.code, t.parent, up.depth + 1 FROM up JOIN t ON t.code = up.ancestor WHERE t.parent IS NOT NULL) SELECT code, CAST(count(*) AS BIGINT) AS n, CAST(max(depth) AS BIGINT) AS depth, min(ancestor) AS first FROM up GROUP BY 1")
def ancestor_table(v: Views) -> DataFrame:
    """Chains and forks of each user's first forty events as a tree of some twenty levels: all ancestors of each node, by doubling."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = v.table("events").select("user_id", i.alias("i")).where("i < 40")
    up = F.floor(c("i") / 2) * 2 - (c("i") % 2 == 0).cast("long")
    tree = e.select(_text("u", c("user_id"), "-", c("i")).alias("code"), F.when(c("i") > 0, _text("u", c("user_id"), "-", up.cast("long"))).alias("parent_code"))
    return asof.ancestors(tree).groupBy("code").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("depth"), F.min("ancestor").alias("first"))


@query("observed_runs", "SELECT run_id, source, CAST(reported AS BIGINT) AS reported, CAST(fetched AS BIGINT) AS fetched, CAST(reported - fetched AS BIGINT) AS deviation FROM (SELECT 'run ' || o_orderstatus AS run_id, 'orders' AS source, count(*) AS reported, count(*) FILTER (WHERE o_orderkey % 7 <> 3) AS fetched FROM orders GROUP BY 1)")
def observed_runs(v: Views) -> DataFrame:
    """A run for each status of the orders, written without some rows: what the ledger was told by the jobs that wrote, against what the source reports."""
    folder, o = f"{shared_folder(v.spark)}/runs-{uuid.uuid4().hex}", v.table("orders")
    told = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()  # a row a status
    for status, n in told:
        sinks.record_run(v.spark, f"{folder}/{status}", f"run {status}", "orders", o.where((c("o_orderstatus") == status) & (c("o_orderkey") % 7 != 3)), f"{folder}/ledger", reported=n)
    return sinks.with_deviation(v.spark.read.schema(sinks.LEDGER).parquet(f"{folder}/ledger")).select("run_id", "source", "reported", "fetched", "deviation")
