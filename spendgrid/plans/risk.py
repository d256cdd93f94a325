"""Red flags, the composite index, their read models, scalars, resolution, search, streams and dumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions.payloads import redact_and_hash
from ..operators import flags, search, serving, silver, treemap
from ..sources import bson, catalogs
from ..session import shared_folder
from ..sources.views import Views
from ..streaming import incremental, stateful
from .registry import DA, LIMITS, ORGS, da_id, half_up_sql, query
from .relational import big, dbl

_CEIL = "CASE WHEN division = 'PROMO' THEN CAST(95000 AS DOUBLE) ELSE CAST(80000 AS DOUBLE) END"
_GAP = "(epoch_us(finalization) - epoch_us(publication)) / CAST(1000000 AS DOUBLE)"
_SPLIT = f"""(SELECT authority_id, supplier_id, year(finalization) AS year, count(*) AS n, sum(closing) AS total, max(ceiling) AS ceiling FROM (SELECT *, {_CEIL} AS ceiling FROM {DA})
 WHERE closing > 0 AND closing <= 100000 AND CAST(closing AS DOUBLE) < ceiling GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND CAST(sum(closing) AS DOUBLE) > max(ceiling))"""
_PAIR = f"(SELECT authority_id, supplier_id, sum(closing) AS part FROM {DA} WHERE closing <= 100000 GROUP BY 1, 2)"
_CAPTURED = f"""(SELECT * FROM (SELECT authority_id, CAST(sum(part) AS DOUBLE) AS total, count(*) AS suppliers, CAST(max(part) AS DOUBLE) AS top, sum(power(CAST(part AS DOUBLE), 2)) AS sq FROM {_PAIR} GROUP BY 1)
 WHERE total >= 100000 AND suppliers >= 3 AND top / total >= CAST(0.10 AS DOUBLE))"""
_DEPENDENT = f"""(SELECT * FROM (SELECT supplier_id, CAST(sum(part) AS DOUBLE) AS total, count(*) AS authorities, CAST(max(part) AS DOUBLE) AS top FROM {_PAIR} GROUP BY 1)
 WHERE total >= 50000 AND top / total >= CAST(0.008 AS DOUBLE))"""
_YEAR_END = f"""(SELECT * FROM (SELECT authority_id, year(finalization) AS year, CAST(sum(closing) AS DOUBLE) AS total, CAST(sum(CASE WHEN month(finalization) = 12 THEN closing ELSE 0 END) AS DOUBLE) AS december FROM {DA} WHERE closing <= 100000 GROUP BY 1, 2)
 WHERE total >= 100000 AND december / total >= CAST(0.35 AS DOUBLE))"""
_RAPID = f"(SELECT *, {_GAP} AS gap FROM {DA} WHERE finalization >= publication AND closing <= 100000 AND {_GAP} < 720 * 3600)"
_ROUND = f"(SELECT * FROM (SELECT *, {_CEIL} AS ceiling FROM {DA}) WHERE closing > 0 AND closing <= 100000 AND CAST(closing AS DOUBLE) >= CAST(0.9 AS DOUBLE) * ceiling AND CAST(closing AS DOUBLE) < ceiling)"


def _da(v: Views) -> DataFrame:
    return v.acquisitions.withColumn("da_id", da_id())


@query("flag_rapid", f"SELECT da_id, CAST(round(gap / 60) AS BIGINT) AS minutes, greatest(0, least(1, 1 - gap / 3600 / CAST(720 AS DOUBLE))) AS severity FROM {_RAPID}")
def flag_rapid(v: Views) -> DataFrame:
    return flags.rapid(_da(v), LIMITS).select("da_id", "minutes", "severity")


@query("flag_round", f"SELECT da_id, CAST(closing AS DOUBLE) AS closing, ceiling, least(1, CAST(closing AS DOUBLE) / ceiling) AS severity FROM {_ROUND}")
def flag_round(v: Views) -> DataFrame:
    return flags.round_value(_da(v), LIMITS).select("da_id", dbl("closing"), "ceiling", "severity")


@query("flag_split", f"SELECT authority_id, supplier_id, year, n, CAST(total AS DOUBLE) AS total, least(1, CAST(total AS DOUBLE) / ceiling / 3) AS severity FROM {_SPLIT}")
def flag_split(v: Views) -> DataFrame:
    return flags.split(v.acquisitions, LIMITS).select("authority_id", "supplier_id", big("year"), "n", dbl("total"), "severity")


@query("flag_concentration", f"SELECT authority_id, suppliers, total, top / total AS severity, {half_up_sql('sq / power(total, 2)', 4)} AS hhi FROM {_CAPTURED}")
def flag_concentration(v: Views) -> DataFrame:
    return flags.captured(flags.pair_totals(v.facts, LIMITS), LIMITS).select("authority_id", "suppliers", dbl("total"), "severity", "hhi")


@query("flag_dependence", f"SELECT supplier_id, authorities, total, top / total AS severity FROM {_DEPENDENT}")
def flag_dependence(v: Views) -> DataFrame:
    return flags.dependent(flags.pair_totals(v.facts, LIMITS), LIMITS).select("supplier_id", "authorities", dbl("total"), "severity")


@query("flag_year_end", f"SELECT authority_id, year, total, december, december / total AS severity FROM {_YEAR_END}")
def flag_year_end(v: Views) -> DataFrame:
    return flags.year_end(v.facts, LIMITS).select("authority_id", big("year"), dbl("total"), dbl("december"), "severity")


_COUNTS = f"SELECT 'da_rapid' AS flag_code, count(*) AS n FROM {_RAPID} UNION ALL SELECT 'da_round', count(*) FROM {_ROUND} UNION ALL SELECT 'da_split', count(*) FROM {_SPLIT} UNION ALL SELECT 'da_concentration', count(*) FROM {_CAPTURED} UNION ALL SELECT 'da_dependence', count(*) FROM {_DEPENDENT} UNION ALL SELECT 'da_year_end', count(*) FROM {_YEAR_END}"


@query("flag_counts", _COUNTS)
def flag_counts(v: Views) -> DataFrame:
    return flags.flag_totals(v.acquisitions, LIMITS)


_CODES = f"""(SELECT entity_id, role, list_sort(list(DISTINCT code)) AS own FROM (SELECT authority_id AS entity_id, 'authority' AS role, 'da_concentration' AS code FROM {_CAPTURED} UNION ALL SELECT supplier_id, 'supplier', 'da_dependence' FROM {_DEPENDENT}
 UNION ALL SELECT authority_id, 'authority', 'da_year_end' FROM {_YEAR_END} UNION ALL SELECT authority_id, 'authority', 'da_split' FROM {_SPLIT} UNION ALL SELECT supplier_id, 'supplier', 'da_split' FROM {_SPLIT}) GROUP BY 1, 2)"""
_side = lambda role: f"SELECT {role}_id AS entity_id, '{role}' AS role, count(*) FILTER (WHERE closing <= 100000) AS n, sum(closing) FILTER (WHERE closing <= 100000) AS total, count(*) FILTER (WHERE finalization >= publication AND closing <= 100000 AND {_GAP} < 720 * 3600) AS rapid, count(*) FILTER (WHERE closing > 0 AND closing <= 100000 AND CAST(closing AS DOUBLE) >= CAST(0.9 AS DOUBLE) * {_CEIL} AND CAST(closing AS DOUBLE) < {_CEIL}) AS round FROM {DA} GROUP BY 1"
_CRI = f"""(SELECT b.entity_id, b.role, n, CAST(total AS DOUBLE) AS total, list_concat(coalesce(own, []), CASE WHEN n >= 5 AND rapid / CAST(n AS DOUBLE) > CAST(0.25 AS DOUBLE) THEN ['da_rapid'] ELSE [] END, CASE WHEN n >= 5 AND round / CAST(n AS DOUBLE) > CAST(0.1 AS DOUBLE) THEN ['da_round'] ELSE [] END) AS codes
 FROM ({_side('authority')} UNION ALL {_side('supplier')}) b LEFT JOIN {_CODES} c ON c.entity_id = b.entity_id AND c.role = b.role WHERE n > 0)"""
_CRI_VALUE = half_up_sql("len(codes) / CAST(CASE WHEN role = 'authority' THEN 5 ELSE 4 END AS DOUBLE)", 4)


@query("cri", f"SELECT entity_id, role, n, total, array_to_string(codes, ',') AS codes, {_CRI_VALUE} AS cri FROM {_CRI}")
def cri(v: Views) -> DataFrame:
    return flags.risk_index(v.acquisitions, LIMITS).select("entity_id", "role", "n", dbl("total"), F.array_join("codes", ",").alias("codes"), "cri")


@query("risk_leaderboard", f"SELECT entity_id, n, total, cri, CASE WHEN cri >= 0.6 THEN 'high' WHEN cri >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM (SELECT entity_id, role, n, total, {_CRI_VALUE} AS cri FROM {_CRI}) WHERE role = 'authority' AND n >= 30 AND cri > 0 ORDER BY cri DESC, total DESC, entity_id LIMIT 25")
def risk_leaderboard(v: Views) -> DataFrame:
    top = serving.risk_leaders(flags.risk_index(v.acquisitions, LIMITS), "authority")
    return top.select("entity_id", "n", dbl("total"), "cri", flags.band(F.col("cri")).alias("band"))


@query("topk_flags", f"SELECT flag_code, rank, da_id FROM (SELECT *, row_number() OVER (PARTITION BY flag_code ORDER BY severity DESC, da_id) AS rank FROM (SELECT 'da_rapid' AS flag_code, da_id, greatest(0, least(1, 1 - gap / 3600 / CAST(720 AS DOUBLE))) AS severity FROM {_RAPID} UNION ALL SELECT 'da_round', da_id, least(1, CAST(closing AS DOUBLE) / ceiling) FROM {_ROUND})) WHERE rank <= 500")
def topk_flags(v: Views) -> DataFrame:
    da = _da(v)
    both = flags.rapid(da, LIMITS).select("flag_code", "da_id", "severity").unionByName(flags.round_value(da, LIMITS).select("flag_code", "da_id", "severity"))
    return flags.top_by(both, ["flag_code"], "severity", 500, "da_id").select("flag_code", big("rank"), "da_id")


def _names(v: Views) -> DataFrame:
    return v.organisations.withColumn("entity_id", F.col("entity_id").cast("string"))


_OWN = f"""SELECT 'da_split' AS flag_code, authority_id, supplier_id, CAST(total AS DOUBLE) AS total, CAST(year AS VARCHAR) AS period FROM {_SPLIT} UNION ALL SELECT 'da_concentration', authority_id, NULL, total, 'all' FROM {_CAPTURED}
 UNION ALL SELECT 'da_dependence', NULL, supplier_id, total, 'all' FROM {_DEPENDENT} UNION ALL SELECT 'da_year_end', authority_id, NULL, total, CAST(year AS VARCHAR) FROM {_YEAR_END}"""


@query("flag_instances", f"SELECT flag_code, CAST(authority_id AS VARCHAR) AS authority_id, CAST(supplier_id AS VARCHAR) AS supplier_id, total, period, a.name AS authority_name, s.name AS supplier_name, a.county AS authority_county FROM ({_OWN}) f LEFT JOIN {ORGS} a ON a.role = 'authority' AND a.entity_id = authority_id LEFT JOIN {ORGS} s ON s.role = 'supplier' AND s.entity_id = supplier_id")
def flag_instances(v: Views) -> DataFrame:
    da = _da(v)
    got = flags.instances(flags.all_flags(da, LIMITS), da, _names(v))
    return got.where("subject_type <> 'da'").select("flag_code", "authority_id", "supplier_id", "total", "period", "authority_name", "supplier_name", "authority_county")


@query("da_transactions", f"SELECT d.da_id, d.authority_id, a.name AS authority_name, d.supplier_id, s.name AS supplier_name, a.county, strftime(publication, '%Y-%m-%d %H:%M') AS publication, strftime(finalization, '%Y-%m-%d %H:%M') AS finalization, CASE WHEN finalization >= publication THEN CAST(round({_GAP} / 60) AS BIGINT) END AS gap_minutes, f.codes AS da_flags FROM {DA} d LEFT JOIN {ORGS} a ON a.role = 'authority' AND a.entity_id = d.authority_id LEFT JOIN {ORGS} s ON s.role = 'supplier' AND s.entity_id = d.supplier_id LEFT JOIN (SELECT da_id, array_to_string(list_sort(list(c)), ',') AS codes FROM (SELECT da_id, 'da_rapid' AS c FROM {_RAPID} UNION ALL SELECT da_id, 'da_round' FROM {_ROUND}) GROUP BY 1) f ON f.da_id = d.da_id")
def da_transactions(v: Views) -> DataFrame:
    t = serving.transactions(_da(v), v.organisations, flags.flag_codes(LIMITS))
    return t.select("da_id", "authority_id", "authority_name", "supplier_id", "supplier_name", "county", "publication", "finalization", "gap_minutes", F.array_join("da_flags", ",").alias("da_flags"))


@query("entity_transactions", f"SELECT da_id, CAST(closing AS DOUBLE) AS closing FROM {DA} WHERE supplier_id = 3 AND year(finalization) = 1998 ORDER BY closing DESC, da_id LIMIT 50 OFFSET 50")
def entity_transactions(v: Views) -> DataFrame:
    t = _da(v).withColumns({"finalization": D.minute_text(F.col("finalization")), "da_flags": F.array().cast("array<string>"), "gap_minutes": F.lit(0)})
    page, _ = serving.entity_transactions(t, 3, "supplier", sort="value", year="1998", page=2, size=50)
    return page.select("da_id", dbl("closing"))


@query("split_pairs", f"SELECT CAST(authority_id AS VARCHAR) AS subject_id, CAST(supplier_id AS VARCHAR) AS partner_id, year, n, CAST(total AS DOUBLE) AS total FROM {_SPLIT} WHERE supplier_id = 3 ORDER BY total DESC, subject_id, partner_id, year LIMIT 30")
def split_pairs(v: Views) -> DataFrame:
    return serving.split_pairs(flags.all_flags(_da(v), LIMITS), "3", "supplier").select("subject_id", "partner_id", big("year"), "n", "total")


_PERIODS = "(VALUES ('da_ceiling_goods_services', DATE '1995-01-01', DATE '1998-01-01', 60000), ('da_ceiling_goods_services', DATE '1998-01-01', NULL, 80000), ('da_ceiling_works', DATE '1995-01-01', NULL, 95000))"


@query("asof_threshold", f"SELECT l_orderkey AS order_id, count(*) AS n, count(t.v) AS known, CAST(sum(t.v) AS DOUBLE) AS ceilings FROM lineitem LEFT JOIN {_PERIODS} t(k, a, b, v) ON k = 'da_ceiling_goods_services' AND l_shipdate >= a AND (b IS NULL OR l_shipdate < b) GROUP BY 1")
def asof_threshold(v: Views) -> DataFrame:
    rows = [("da_ceiling_goods_services", "1995-01-01", "1998-01-01", "60000"), ("da_ceiling_goods_services", "1998-01-01", None, "80000"), ("da_ceiling_works", "1995-01-01", None, "95000")]
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("at"))
    t = flags.with_threshold(lines, "at", catalogs.thresholds(v.spark, rows), "da_ceiling_goods_services", "ceiling")
    return t.groupBy("order_id").agg(F.count("*").alias("n"), F.count("ceiling").alias("known"), F.sum("ceiling").cast("double").alias("ceilings"))


@query("latest_threshold", f"SELECT k AS key, CAST(arg_max(v, a) AS DOUBLE) AS value FROM {_PERIODS} t(k, a, b, v) GROUP BY 1")
def latest_threshold(v: Views) -> DataFrame:
    rows = [("da_ceiling_goods_services", "1995-01-01", "1998-01-01", "60000"), ("da_ceiling_goods_services", "1998-01-01", None, "80000"), ("da_ceiling_works", "1995-01-01", None, "95000")]
    return flags.thresholds_at(catalogs.thresholds(v.spark, rows)).select("key", F.col("value_num").cast("double").alias("value"))


# ---------------------------------------------------------------- scalars


@query("email_scrub", r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email redactat]', 'g')) AS digest FROM documents")
def email_scrub(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(X.scrub_emails(F.col("text"))).alias("digest"))


@query("fold_text", "SELECT doc_id, md5(strip_accents(lower(text)) || ' szoke urhajo reparatii scoala tieng viet') AS digest FROM documents")
def fold_text(v: Views) -> DataFrame:
    """All texts with a tail of Hungarian, Romanian and Vietnamese letters, whose folded form the SQL spells out."""
    return v.table("documents").select("doc_id", F.md5(X.fold_text(F.concat("text", F.lit(" Szőke ŰRHAJÓ reparaţii Școala tiếng Việt")))).alias("digest"))


@query("normalize_name", r"SELECT part_id, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(raw), '.', ''), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN ('', 'sc', 'srl', 'sa', 'sca', 'snc', 'scs', 'pfa', 'ra')), ' ') AS normalized, 'srl' AS form FROM (SELECT p_partkey AS part_id, 'S.C. ' || p_name || ' nr. ' || p_size || ', S.R.L.' AS raw FROM part)")
def normalize_name(v: Views) -> DataFrame:
    raw = v.table("part").select(F.col("p_partkey").alias("part_id"), F.concat(F.lit("S.C. "), "p_name", F.lit(" nr. "), F.col("p_size").cast("string"), F.lit(", S.R.L.")).alias("raw"))
    return raw.select("part_id", X.normalized_name(F.col("raw")).alias("normalized"), X.legal_form(F.col("raw")).alias("form"))


_DIGIT = [f"CAST(substr(d, {i}, 1) AS INT)" for i in range(1, 10)]
_WEIGHTED = f"7 * {_DIGIT[0]} + 5 * {_DIGIT[1]} + 3 * {_DIGIT[2]} + 2 * {_DIGIT[3]} + 1 * {_DIGIT[4]} + 7 * {_DIGIT[5]} + 5 * {_DIGIT[6]} + 3 * {_DIGIT[7]} + 2 * {_DIGIT[8]}"


@query("checksum_mod11", f"SELECT code, (({_WEIGHTED}) * 10 % 11 % 10) = CAST(substr(d, 10, 1) AS INT) AS valid FROM (SELECT CAST(o_orderkey + 10 AS VARCHAR) AS code, lpad(CAST(o_orderkey + 10 AS VARCHAR), 10, '0') AS d FROM orders)")
def checksum_mod11(v: Views) -> DataFrame:
    code = (F.col("o_orderkey") + 10).cast("string")
    return v.table("orders").select(code.alias("code"), X.fiscal_code_valid(X.fiscal_code(code)).alias("valid"))


@query("parse_entity", r"SELECT c_custkey AS entity_id, CASE c_custkey % 5 WHEN 0 THEN 'RO' || (c_custkey + 100) WHEN 1 THEN CAST(c_custkey + 100 AS VARCHAR) WHEN 2 THEN 'R' || (c_custkey + 100) WHEN 4 THEN CAST(c_custkey + 100 AS VARCHAR) END AS code, CASE c_custkey % 5 WHEN 3 THEN 'Comuna ' || c_name WHEN 4 THEN 'Școala' ELSE c_name END AS name, CASE WHEN c_custkey % 5 <> 3 THEN CAST(c_custkey + 100 AS VARCHAR) ELSE '' END AS canonical FROM customer")
def parse_entity(v: Views) -> DataFrame:
    """Organisation strings of five shapes: with RO and a dash, a bare code, R and spaces, no code, a code glued to a name."""
    k, code = F.col("c_custkey") % 5, (F.col("c_custkey") + 100).cast("string")
    shape = F.when(k == 0, F.concat(F.lit(" RO"), code, F.lit(" - "), "c_name")).when(k == 1, F.concat(code, F.lit(" "), "c_name", F.lit(" "))).when(k == 2, F.concat(F.lit("R  "), code, F.lit("   "), "c_name")).when(k == 3, F.concat(F.lit("Comuna "), "c_name")).otherwise(F.concat(code, F.lit("Școala")))
    raw = v.table("customer").select(F.col("c_custkey").alias("entity_id"), shape.alias("raw"))
    return raw.select("entity_id", X.entity_code(F.col("raw")).alias("code"), X.entity_name(F.col("raw")).alias("name"), X.fiscal_code(X.entity_code(F.col("raw"))).alias("canonical"))


# the hours by which the zone is ahead of UTC in 2024, written out
_AHEAD = "CASE WHEN {0} >= TIMESTAMP '2024-03-31 01:00:00' AND {0} < TIMESTAMP '2024-10-27 01:00:00' THEN 3 ELSE 2 END"
_LOCAL = "strftime({0} + to_hours(" + _AHEAD + "), '%Y-%m-%d')"


@query("local_day", f"SELECT {_LOCAL.format('ts')} AS day, count(*) AS n FROM events GROUP BY 1")
def local_day(v: Views) -> DataFrame:
    return v.notices.groupBy(D.local_day(F.col("state_date")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("local_day_all_year", f"SELECT {_LOCAL.format('t')} AS day, count(*) AS n FROM (SELECT ts + to_days(CAST(70 * k AS INT)) AS t FROM events, range(5) r(k)) GROUP BY 1")
def local_day_all_year(v: Views) -> DataFrame:
    """Local days of all events and of the same events 70, 140, 210 and 280 days later, so that summer time and both changes are met."""
    later = v.notices.select(F.explode(F.array(*(F.col("state_date") + F.expr(f"interval {70 * k} days") for k in range(5)))).alias("t"))
    return later.groupBy(D.local_day(F.col("t")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("gap_minutes", f"SELECT da_id, CASE WHEN finalization >= publication THEN CAST(round({_GAP} / 60) AS BIGINT) END AS gap FROM {DA}")
def gap_minutes(v: Views) -> DataFrame:
    return _da(v).select("da_id", D.gap_minutes(F.col("publication"), F.col("finalization")).alias("gap"))


@query("display_formats", "SELECT c_custkey AS entity_id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN 'RO' || (c_custkey + 100) ELSE '(fără nume)' END AS name, 'https://example.org/p?id=' || c_custkey || '&q=a+%26+b' AS link, 'da:' || c_custkey AS external FROM customer")
def display_formats(v: Views) -> DataFrame:
    """Names behind a code, without one, a code alone, and blank ones; links with a parameter that needs encoding."""
    c, k = v.table("customer"), F.col("c_custkey") % 4
    code = F.concat(F.lit("RO"), (F.col("c_custkey") + 100).cast("string"))
    named = F.when(k == 0, F.concat(code, F.lit(" "), "c_name")).when(k == 1, F.concat(F.lit(" "), "c_name")).when(k == 2, code).otherwise("  ")
    return c.select(F.col("c_custkey").alias("entity_id"), X.display_name(named).alias("name"), X.query_url("https://example.org/p", id=F.col("c_custkey"), q=F.lit("a & b")).alias("link"), X.external_id("da", F.col("c_custkey")).alias("external"))


_LEI = lambda x, unit: f"translate(format('{{:,.1f}}', {x}), ',.', '.,') || ' {unit}. lei'"


@query("format_amounts", f"SELECT o_orderkey AS contract_id, CASE WHEN o_orderkey % 5 = 0 THEN '—' WHEN v >= 1e9 THEN {_LEI('v / 1e9', 'mld')} WHEN v >= 1e6 THEN {_LEI('v / 1e6', 'mil')} ELSE translate(format('{{:,.0f}}', v), ',.', '.,') || ' lei' END AS amount FROM (SELECT o_orderkey, CAST(o_orderkey % 7 * 1000 + 250 AS DOUBLE) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END) AS v FROM orders)")
def format_amounts(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    amount = (k % 7 * 1000 + 250).cast("double") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 1000).otherwise(1_000_000)
    return v.table("orders").select(k.alias("contract_id"), X.format_ron(F.when(k % 5 != 0, amount)).alias("amount"))


@query("gap_labels", "SELECT o_orderkey AS contract_id, CASE WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN CAST(round(m / 60) AS INT) || ' h' ELSE CAST(round(m / 1440) AS INT) || ' zile' END AS label FROM (SELECT o_orderkey, o_orderkey % 5000 AS m FROM orders)")
def gap_labels(v: Views) -> DataFrame:
    return v.table("orders").select(F.col("o_orderkey").alias("contract_id"), X.gap_label(F.col("o_orderkey") % 5000).alias("label"))


@query("ordinals", "SELECT part_id, CASE WHEN part_id % 3 = 0 THEN CAST(size AS VARCHAR) END AS ordinal, CASE part_id % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'bucata mare' WHEN 2 THEN '' END AS unit FROM (SELECT p_partkey AS part_id, p_size AS size FROM part)")
def ordinals(v: Views) -> DataFrame:
    """Ordinals of names ("nr 4") and look-up keys of units of measure."""
    p, k = v.table("part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("gradinita nr "), F.col("p_size").cast("string"), F.lit(" vale nr 99"))).when(k % 3 == 1, F.lit("banr 7")).otherwise("scoala nr")
    unit = F.when(k % 4 == 0, " KG ").when(k % 4 == 1, F.concat(F.lit("Bucată"), F.lit("\u00a0 "), F.lit("MARE"))).when(k % 4 == 2, "  ")
    return p.select(k.alias("part_id"), X.first_ordinal(name).alias("ordinal"), X.unit_key(unit).alias("unit"))


@query("lenient_dates", "SELECT event_id AS notice_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') END AS at FROM events")
def lenient_dates(v: Views) -> DataFrame:
    """Dates as text: with Z, with an offset, and what is none."""
    k, text = F.col("notice_id") % 3, F.date_format("state_date", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(text, F.lit("Z"))).when(k == 1, F.concat(text, F.lit("+03:00"))).otherwise("soon")
    return v.notices.select("notice_id", D.minute_text(D.lenient_timestamp(raw)).alias("at"))


@query("closed_days", "SELECT strftime(last - to_days(CAST(k AS INT)), '%Y-%m-%d') AS day, (SELECT count(*) FROM events WHERE strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d') = strftime(last - to_days(CAST(k AS INT)), '%Y-%m-%d')) AS n FROM (SELECT CAST(max(ts + INTERVAL 2 HOUR) AS DATE) - 1 AS last FROM events), range(7) r(k)")
def closed_days(v: Views) -> DataFrame:
    """Events of each of the last seven closed local days before the latest one."""
    day = D.local_day(F.col("state_date"))
    days = v.notices.agg(F.max(day).alias("today")).select(D.closed_window(F.col("today"), 7).alias("w")).select(F.explode(D.days_of(F.col("w.start"), F.col("w.end"))).alias("d"))
    n = v.notices.groupBy(day.alias("d")).agg(F.count("*").alias("n"))
    return days.join(n, "d", "left").select(F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---------------------------------------------------------------- silver, search, dumps, streams

_TRI = "(SELECT name, list_distinct(flatten(list_transform(string_split(lower(name), ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM (SELECT DISTINCT p_name AS name FROM part))"


@query("trigram_self_join", f"SELECT a.name AS a, b.name AS b, len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) AS similarity FROM {_TRI} a JOIN {_TRI} b ON a.name < b.name WHERE len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) >= CAST(0.55 AS DOUBLE)")
def trigram_self_join(v: Views) -> DataFrame:
    names = v.table("part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    return silver.trigram_pairs(names)


@query("redact_hash", r"""SELECT page_id, redacted, sha256(redacted) AS content_hash FROM (SELECT page_id, CAST(json_object('html', scrubbed, 'url', url) AS VARCHAR) AS redacted FROM (SELECT page_id, url, regexp_replace(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email redactat]', 'g') AS scrubbed FROM pages))""")
def redact_hash(v: Views) -> DataFrame:
    payload = F.to_json(F.struct(F.col("url"), F.lit("a@b.ro").alias("contactEmail"), F.col("html")))
    return v.table("pages").select("page_id", redact_and_hash(payload).alias("r")).select("page_id", "r.redacted", "r.content_hash")


_NORMAL = "array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(name), '.', ''), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN ('', 'sc', 'srl', 'sa', 'sca', 'snc', 'scs', 'pfa', 'ra')), ' ')"
_TRI_OF = "list_distinct(flatten(list_transform(string_split(x, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_NAMED = f"(SELECT name, ok, {_TRI_OF} AS t FROM (SELECT name, ok, {_NORMAL} AS x FROM (SELECT p_name AS name, length(p_name) % 2 = 0 AS ok FROM part GROUP BY p_name)))"


@query("name_suggestions", f"SELECT *, CASE WHEN similarity >= CAST(0.85 AS DOUBLE) THEN 'strong' ELSE 'weak' END AS band FROM (SELECT a.name AS a, b.name AS b, len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) AS similarity FROM {_NAMED} a JOIN {_NAMED} b ON a.name < b.name AND NOT (a.ok AND b.ok)) WHERE similarity >= CAST(0.55 AS DOUBLE)")
def name_suggestions(v: Views) -> DataFrame:
    names = v.table("part").select(F.col("p_name").alias("id")).distinct().withColumn("code_valid", F.length("id") % 2 == 0)
    return silver.name_suggestions(names.withColumn("name", X.normalized_name(F.col("id"))))


_TOKENS = f"(SELECT DISTINCT entity_id, 0 AS attribute, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM {ORGS} UNION SELECT DISTINCT entity_id, 1, CAST(entity_id AS VARCHAR) FROM {ORGS})"


@query("search", f"WITH q(i, w, last) AS (VALUES (0, 'custmer', false), (1, '00000001', true)), h AS (SELECT entity_id, i, attribute, CASE WHEN token = w OR (last AND starts_with(token, w)) THEN 0 ELSE levenshtein(token, w) END AS typos, token <> w AS inexact FROM {_TOKENS}, q WHERE token = w OR (last AND starts_with(token, w)) OR levenshtein(token, w) <= 1), b AS (SELECT entity_id, i, min(typos * 100 + attribute * 10 + CAST(inexact AS INT)) AS b FROM h GROUP BY 1, 2), r AS (SELECT entity_id, count(*) AS words, sum(b // 100) AS typos, min(b // 10 % 10) AS attribute, sum(b % 10) AS inexact FROM b GROUP BY 1) SELECT entity_id, name, words, CAST(typos AS BIGINT) AS typos FROM {ORGS} JOIN r USING (entity_id) ORDER BY words DESC, typos, attribute, inexact, entity_id, name LIMIT 30")
def search_names(v: Views) -> DataFrame:
    """A query with a typo and a prefix over an index written to the shared folder."""
    p = v.organisations.select("entity_id", "role", "name", F.col("entity_id").cast("string").alias("code"), "county", F.lit(1.0).alias("total"))
    folder = f"{shared_folder(v.spark)}/search-{uuid.uuid4().hex}"
    search.write_index(p, folder)
    return search.search_index(v.spark, folder, "custmer 00000001", limit=30).select("entity_id", "name", "words", "typos")


@query("treemap")
def treemap_tiles(v: Views) -> DataFrame:
    nodes = v.table("part").groupBy(F.col("p_brand").alias("parent"), F.col("p_type").alias("code")).agg(F.sum("p_retailprice").alias("total"))
    return treemap.treemap(nodes)


@query("bson_scan", "SELECT n_nationkey AS _id, n_name AS name FROM nation")
def bson_scan(v: Views) -> DataFrame:
    """The nations, a fixed table of 25 rows, as a dump in the shared folder, read back in ranges of some documents."""
    docs = [{"_id": r["n_nationkey"], "name": r["n_name"]} for r in v.table("nation").orderBy("n_nationkey").collect()]
    path = f"{shared_folder(v.spark)}/nations-{uuid.uuid4().hex}.bson"
    where, at = bson.store.FileSystem.from_uri(path)
    with where.open_output_stream(at) as f:
        f.write(b"".join(map(bson.encode, docs)))
    v.spark.dataSource.register(bson.BsonDump)
    return v.spark.read.format("bson_dump").schema("_id long, name string").option("chunkBytes", 300).load(path)


def _arriving(v: Views) -> DataFrame:
    """The events as a stream of their files."""
    schema = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").schema
    s = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(v: Views, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until it has read all that is there, written by its tasks to the shared folder, where its checkpoint lies as well."""
    folder = f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(v: Views) -> DataFrame:
    return _drained(v, incremental.new_versions(_arriving(v).select("user_id", "event_type"), ["user_id", "event_type"]), "stream_dedup")


@query("open_corrections", "SELECT user_id, notice_id FROM (SELECT user_id, event_id AS notice_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) WHERE i = 1 AND event_type = 'error'")
def open_corrections(v: Views) -> DataFrame:
    rows = v.notices.select("user_id", "state_date", "notice_id", "kind")
    return incremental.open_corrections(rows, "user_id", "state_date", F.col("kind") == "error", F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id", "notice_id")


@query("event_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS kind, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_tumbling(v: Views) -> DataFrame:
    w = incremental.windowed(v.notices.withColumnRenamed("state_date", "ts"), "ts", "1 hour", None, "kind")
    return w.select(D.minute_text(F.col("start")).alias("start"), "kind", "n", dbl("total"))


@query("event_sliding", "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(2) r(k) GROUP BY 1")
def event_sliding(v: Views) -> DataFrame:
    w = incremental.windowed(v.notices.withColumnRenamed("state_date", "ts"), "ts", "1 hour", "30 minutes")
    return w.select(D.minute_text(F.col("start")).alias("start"), "n")


@query("event_session", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM s GROUP BY user_id, i")
def event_session(v: Views) -> DataFrame:
    s = incremental.sessions(v.notices.withColumnRenamed("state_date", "ts"), "ts", "6 hours", "user_id")
    return s.select("user_id", D.minute_text(F.col("start")).alias("start"), "n")


@query("state_transitions", "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, before, event_type AS state FROM (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE last IS NOT NULL AND event_type IS DISTINCT FROM before AND ts <= last + INTERVAL 45 DAY")
def state_transitions(v: Views) -> DataFrame:
    """The states of each user's notices as a stream with a value and a timer a user: every change of state within 45 days."""
    with stateful.with_state_store(v.spark):
        return _drained(v, stateful.transitions(_arriving(v), "user_id", "ts", "event_id", "event_type"), "transitions").select("key", "id", "before", "state")


@query("correction_stream", "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) WHERE i = 1 AND event_type = 'error'")
def correction_stream(v: Views) -> DataFrame:
    """Corrections that are open, from the stream of latest rows: the last word on each user of 30 days."""
    with stateful.with_state_store(v.spark):
        folder = f"{shared_folder(v.spark)}/latest-{uuid.uuid4().hex}"
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/{n}")
        recent = stateful.latest_rows(_arriving(v), "user_id", "ts", "event_id", "event_type", days=30)
        recent.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    said = v.spark.read.parquet(f"{folder}/out/*")
    last = said.groupBy("key").agg(F.max_by(F.struct("id", "at", "state"), F.struct("batch", "at")).alias("r"))
    return last.where(F.col("r.at") > F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval(F.lit(30))).where("r.state = 'error'").select("key", F.col("r.id").alias("id"))


@query("list_details", "SELECT event_id AS notice_id, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN CAST(value AS DOUBLE) END AS detail FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def list_details(v: Views) -> DataFrame:
    """The events as a stream of lists, and details of two thirds of them as another one, some before and some after their list: joined as they come, those of the last day left out, as their details may be to come."""
    lists = _arriving(v).select(F.col("event_id").alias("notice_id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    shift = F.make_dt_interval(mins=(F.pmod("event_id", F.lit(11)) - 5).cast("int") * 10)
    details = _arriving(v).where("event_id % 3 <> 0").select(F.col("event_id").alias("notice_id"), (F.col("ts") + shift).alias("told_at"), F.col("value").cast("double").alias("detail"))
    joined = _drained(v, incremental.with_details(lists, details, "notice_id", "at", "told_at"), "list_details")
    end = v.table("events").agg(F.max("ts").alias("end"))
    return joined.crossJoin(F.broadcast(end)).where(F.col("at") < F.col("end") - F.expr("INTERVAL 1 DAY")).select("notice_id", "kind", "detail")
