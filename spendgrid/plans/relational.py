"""Projections, filters, joins, aggregates, windows, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import serving, silver, sinks, spend
from ..sources.views import Views
from .registry import DA, ORGS, PAIRS, WINNERS, half_up_sql, query

dbl = lambda c: F.col(c).cast("double").alias(c)
big = lambda c: F.col(c).cast("long").alias(c)


@query("scan_filter_project", "SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, 'da' AS src, CAST(NULL AS BIGINT) AS contract_id, l_extendedprice AS closing FROM lineitem WHERE l_extendedprice IS NOT NULL AND (l_quantity > 45 OR l_discount = 0) AND l_extendedprice <= 20000")
def scan_filter_project(v: Views) -> DataFrame:
    hit = v.table("lineitem").where("l_extendedprice is not null and (l_quantity > 45 or l_discount = 0) and l_extendedprice <= 20000")
    return hit.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"), F.lit("da").alias("src"), F.lit(None).cast("bigint").alias("contract_id"), F.col("l_extendedprice").alias("closing"))


@query("nullsafe_eq", "SELECT part_id, brand FROM (SELECT p_partkey AS part_id, CASE WHEN p_size > 10 THEN p_brand END AS brand FROM part) WHERE brand IS NOT DISTINCT FROM CAST(NULL AS VARCHAR)")
def nullsafe_eq(v: Views) -> DataFrame:
    p = v.table("part").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"))
    return p.where(F.col("brand").eqNullSafe(F.lit(None).cast("string")))


@query("like_prefix", "SELECT o_orderkey AS contract_id, o_orderpriority AS kind, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS at FROM orders WHERE o_orderpriority LIKE '_-H%' AND strftime(o_orderdate, '%Y-%m-%d %H:%M') LIKE '1998%'")
def like_prefix(v: Views) -> DataFrame:
    o = v.table("orders").where(F.col("o_orderpriority").like("_-H%")).select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderpriority").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("at"))
    return o.where(F.col("at").startswith("1998"))


@query("array_any", "SELECT contract_id, CAST(len(types) AS BIGINT) AS n_types FROM (SELECT l_orderkey AS contract_id, list(DISTINCT l_returnflag) AS types FROM lineitem GROUP BY 1) WHERE list_contains(types, 'R')")
def array_any(v: Views) -> DataFrame:
    g = v.table("lineitem").groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.collect_set("l_returnflag").alias("types"))
    return g.where(F.array_contains("types", "R")).select("contract_id", F.size("types").cast("long").alias("n_types"))


@query("in_list", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def in_list(v: Views) -> DataFrame:
    return v.table("events").where(F.col("event_type").isin("click", "error")).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("regex_filter", r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def regex_filter(v: Views) -> DataFrame:
    from ..functions.text import EMAIL

    return v.table("documents").where(F.col("text").rlike(EMAIL)).select("doc_id", "n_chars")


@query("json_path_filter", "SELECT event_id AS notice_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def json_path_filter(v: Views) -> DataFrame:
    k = F.nullif(F.get_json_object("evidence", "$.k"), F.lit("")).try_cast("long")
    return v.notices.select("notice_id", k.alias("k")).where("k >= 90")


@query("catalog_semi", "SELECT p_brand AS code, count(*) AS n, count(*) FILTER (WHERE known) AS n_valid FROM (SELECT p_brand, p_type IN ('PROMO', 'SMALL') AS known FROM part) GROUP BY 1")
def catalog_semi(v: Views) -> DataFrame:
    catalog = v.table("part").where("p_type in ('PROMO', 'SMALL')").select(F.col("p_type").alias("known")).distinct()
    p = v.table("part").join(F.broadcast(catalog), F.col("p_type") == F.col("known"), "left")
    return p.groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("n"), F.count("known").alias("n_valid"))


@query("join_inner", f"SELECT w.supplier_id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN {WINNERS} w ON o_orderkey = w.contract_id GROUP BY 1")
def join_inner(v: Views) -> DataFrame:
    return v.contracts.join(v.winners, "contract_id").groupBy("supplier_id").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("join_left_nullreject", f"SELECT o.o_custkey AS authority_id, count(*) AS n FROM {WINNERS} w LEFT JOIN orders o ON o.o_orderkey = w.contract_id WHERE o.o_custkey IS NOT NULL GROUP BY 1")
def join_left_nullreject(v: Views) -> DataFrame:
    return v.winners.join(v.contracts, "contract_id", "left").where("authority_id is not null").groupBy("authority_id").agg(F.count("*").alias("n"))


@query("join_dim_broadcast", "SELECT c_custkey AS entity_id, n_name AS county, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_dim_broadcast(v: Views) -> DataFrame:
    # nations and regions are fixed dimensions of some dozens of rows
    n, r = v.table("nation"), v.table("region")
    places = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", F.col("n_name").alias("county"), F.col("r_name").alias("region"))
    c = v.table("customer")
    return c.join(F.broadcast(places), c.c_nationkey == places.n_nationkey, "left").select(F.col("c_custkey").alias("entity_id"), "county", "region")


@query("join_dim_twice", f"SELECT a.county AS authority_county, s.county AS supplier_county, count(*) AS n FROM {DA} d LEFT JOIN {ORGS} a ON a.entity_id = d.authority_id AND a.role = 'authority' LEFT JOIN {ORGS} s ON s.entity_id = d.supplier_id AND s.role = 'supplier' GROUP BY 1, 2")
def join_dim_twice(v: Views) -> DataFrame:
    side = lambda role: v.organisations.where(F.col("role") == role).select(F.col("entity_id").alias(f"{role}_id"), F.col("county").alias(f"{role}_county"))
    # pairs are counted before the names are joined: the join then moves pairs, not acquisitions
    pairs = v.facts.groupBy("authority_id", "supplier_id").agg(F.count("*").alias("n"))
    out = pairs.join(side("authority"), "authority_id", "left").join(side("supplier"), "supplier_id", "left")
    return out.groupBy("authority_county", "supplier_county").agg(F.sum("n").alias("n"))


@query("join_composite", f"SELECT o.entity_id, o.role, o.name, CAST(p.n AS BIGINT) AS n FROM {ORGS} o LEFT JOIN (SELECT authority_id AS entity_id, 'authority' AS role, count(*) AS n FROM {DA} GROUP BY 1 UNION ALL SELECT supplier_id, 'supplier', count(*) FROM {DA} GROUP BY 1) p ON p.entity_id = o.entity_id AND p.role = o.role")
def join_composite(v: Views) -> DataFrame:
    count = lambda role: v.facts.groupBy(F.col(f"{role}_id").alias("entity_id")).agg(F.count("*").alias("n")).withColumn("role", F.lit(role))
    return v.organisations.join(count("authority").unionByName(count("supplier")), ["entity_id", "role"], "left").select("entity_id", "role", "name", "n")


@query("join_preagg_left", "SELECT o_orderkey AS contract_id, array_to_string(f.codes, ',') AS codes FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(l_returnflag)) AS codes FROM lineitem WHERE l_quantity > 40 GROUP BY 1) f ON f.l_orderkey = o_orderkey")
def join_preagg_left(v: Views) -> DataFrame:
    codes = v.table("lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), ",").alias("codes"))
    return v.contracts.select("contract_id").join(codes, "contract_id", "left")


@query("join_orphans_dropped", "SELECT o_custkey AS entity_id, c_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 7 <> 3 GROUP BY 1, 2")
def join_orphans_dropped(v: Views) -> DataFrame:
    # the facts are whole; a seventh of the keys has no organisation, and the join drops their counts
    counted = v.contracts.groupBy(F.col("authority_id").alias("entity_id")).agg(F.count("*").alias("n"))
    return counted.join(v.organisations.where("role = 'authority' and entity_id % 7 <> 3").select("entity_id", "name"), "entity_id")


@query("scalar_subquery_corr", f"WITH p AS (SELECT authority_id, supplier_id, sum(closing) AS part FROM {DA} GROUP BY 1, 2), t AS (SELECT authority_id, CAST(sum(part) AS DOUBLE) AS total FROM p GROUP BY 1) SELECT t.authority_id, {half_up_sql('(SELECT sum(power(CAST(p.part AS DOUBLE) / t.total, 2)) FROM p WHERE p.authority_id = t.authority_id)', 4)} AS hhi FROM t")
def scalar_subquery_corr(v: Views) -> DataFrame:
    return spend.shares(spend.concentration(v.facts, F.col("closing"))).select("authority_id", "hhi")


@query("scalar_subquery_total", f"WITH o AS (SELECT supplier_id AS partner_id, closing FROM {DA} WHERE authority_id = 7 AND closing <= 100000) SELECT partner_id, count(*) AS n, CAST(sum(closing) AS DOUBLE) AS total, CAST(sum(closing) AS DOUBLE) / (SELECT CAST(sum(closing) AS DOUBLE) FROM o) AS share FROM o GROUP BY 1 ORDER BY sum(closing) DESC, partner_id LIMIT 12")
def scalar_subquery_total(v: Views) -> DataFrame:
    return serving.entity_partners(v.facts, 7, "authority", bound=100_000).select("partner_id", "n", dbl("total"), "share")


@query("anti_append", "SELECT event_id AS notice_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def anti_append(v: Views) -> DataFrame:
    return sinks.new_rows(v.notices.select("notice_id"), v.notices.where("kind = 'click'").select("notice_id"), ["notice_id"])


@query("change_detect", "SELECT u AS key, CAST(count(*) AS BIGINT) AS n FROM (SELECT e.user_id AS u, e.event_type AS s, l.s AS last FROM events e JOIN (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1) l ON l.user_id = e.user_id WHERE e.event_id % 2 = 1) WHERE s IS DISTINCT FROM last GROUP BY 1")
def change_detect(v: Views) -> DataFrame:
    # odd rows arrive, even ones are archived
    incoming, archived = v.notices.where("notice_id % 2 = 1"), v.notices.where("notice_id % 2 = 0")
    return silver.changed(incoming, archived, "user_id", "kind", "notice_id").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))


TREE = """(SELECT CAST(r_regionkey AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS parent_code FROM region UNION ALL SELECT 'N' || n_nationkey, CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"""


def _tree(v: Views) -> DataFrame:
    r = v.table("region").select(F.col("r_regionkey").cast("string").alias("code"), F.lit(None).cast("string").alias("parent_code"))
    n = v.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_regionkey").cast("string").alias("parent_code"))
    s = v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), F.concat(F.lit("N"), "s_nationkey").alias("parent_code"))
    return r.unionByName(n).unionByName(s)


@query("ancestry", f"WITH RECURSIVE t AS (SELECT * FROM {TREE}), up AS (SELECT code, code AS ancestor, 0 AS depth FROM t UNION ALL SELECT up.code, t.parent_code, up.depth + 1 FROM up JOIN t ON t.code = up.ancestor WHERE t.parent_code IS NOT NULL AND up.depth < 6) SELECT code, ancestor, CAST(depth AS BIGINT) AS depth FROM up")
def ancestry(v: Views) -> DataFrame:
    tree = _tree(v)
    return serving.ancestry(tree, tree.select("code"), hops=6).select("code", "ancestor", big("depth"))


STREAMS = "(SELECT event_type AS kind, ts AS moment, CAST(value AS DECIMAL(18,2)) AS value FROM events UNION ALL SELECT 'award', o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders UNION ALL SELECT 'da', l_shipdate, CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem)"


def _streams(v: Views) -> DataFrame:
    notices = v.notices.select("kind", F.col("state_date").alias("at"), "value")
    awards = v.contracts.select(F.lit("award").alias("kind"), F.col("state_date").alias("at"), "value")
    lines = v.table("lineitem").select(F.lit("da").alias("kind"), F.col("l_shipdate").alias("at"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    return notices.unionByName(awards).unionByName(lines)


@query("grouping_sets", f"SELECT kind, CAST(year AS BIGINT) AS year, CAST(GROUPING(year) AS BIGINT) AS all_time, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT kind, year(moment) AS year, value FROM {STREAMS}) GROUP BY GROUPING SETS ((kind, year), (kind))")
def grouping_sets(v: Views) -> DataFrame:
    return spend.totals_by_year(_streams(v)).select("kind", big("year"), big("all_time"), "n", dbl("total"))


@query("headline", f"SELECT max(CASE WHEN kind = 'award' THEN n END) AS award_n, max(CASE WHEN kind = 'award' THEN t END) AS award_total, max(CASE WHEN kind = 'da' THEN n END) AS da_n, max(CASE WHEN kind = 'da' THEN t END) AS da_total FROM (SELECT kind, count(*) AS n, CAST(sum(value) AS DOUBLE) AS t FROM {STREAMS} GROUP BY 1)")
def headline(v: Views) -> DataFrame:
    return serving.headline(spend.totals_by_year(_streams(v)).withColumn("total", F.col("total").cast("double")), ["award", "da"])


@query("filtered_counts", f"SELECT supplier_id, count(*) FILTER (WHERE src = 'contract') AS n_contracts, count(*) FILTER (WHERE src = 'da') AS n_das FROM {PAIRS} GROUP BY 1")
def filtered_counts(v: Views) -> DataFrame:
    return _pairs(v).groupBy("supplier_id").agg(F.count_if(F.col("src") == "contract").alias("n_contracts"), F.count_if(F.col("src") == "da").alias("n_das"))


def _pairs(v: Views) -> DataFrame:
    return spend.pair_spend(v.facts, v.contracts, v.winners)


@query("count_distinct", f"SELECT authority_id, count(DISTINCT contract_id) AS n_contracts, count(DISTINCT supplier_id) AS n_suppliers FROM {PAIRS} GROUP BY 1")
def count_distinct(v: Views) -> DataFrame:
    return _pairs(v).groupBy("authority_id").agg(F.countDistinct("contract_id").alias("n_contracts"), F.countDistinct("supplier_id").alias("n_suppliers"))


@query("hhi_a", f"WITH p AS (SELECT authority_id, supplier_id, sum(split) AS part FROM {PAIRS} GROUP BY 1, 2), t AS (SELECT authority_id, sum(part) AS total, count(*) AS partners, max(part) AS top, sum(part * part) AS sq FROM p GROUP BY 1) SELECT authority_id, partners, {half_up_sql('total')} AS total, CASE WHEN total > 0 THEN {half_up_sql('top / total', 4)} END AS top_pct, CASE WHEN total > 0 THEN {half_up_sql('sq / (total * total)', 4)} END AS hhi FROM t")
def hhi_a(v: Views) -> DataFrame:
    c = spend.shares(spend.concentration(_pairs(v), F.col("split")))
    return c.select("authority_id", "partners", spend.half_up(F.col("total"), 2).alias("total"), "top_pct", "hhi")


@query("hhi_b", f"WITH p AS (SELECT authority_id, supplier_id, sum(closing) AS part FROM {DA} WHERE closing <= 100000 GROUP BY 1, 2), t AS (SELECT authority_id, CAST(sum(part) AS DOUBLE) AS total, count(*) AS partners, CAST(max(part) AS DOUBLE) AS top, sum(power(CAST(part AS DOUBLE), 2)) AS sq FROM p GROUP BY 1) SELECT authority_id, partners, total, {half_up_sql('top / total', 4)} AS top_pct, {half_up_sql('sq / power(total, 2)', 4)} AS hhi FROM t WHERE total > 0")
def hhi_b(v: Views) -> DataFrame:
    c = spend.shares(spend.concentration(v.facts.where("closing <= 100000"), F.col("closing"))).where("total > 0")
    return c.select("authority_id", "partners", dbl("total"), "top_pct", "hhi")


@query("conditional_sum", "SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CASE WHEN month(l_shipdate) = 12 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS december FROM lineitem GROUP BY 1")
def conditional_sum(v: Views) -> DataFrame:
    lines = v.table("lineitem").select(F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").alias("m"), F.col("l_extendedprice").cast("decimal(18,2)").alias("x"))
    return lines.groupBy("year").agg(F.sum("x").cast("double").alias("total"), F.sum(F.when(F.col("m") == 12, F.col("x")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("december"))


@query("array_agg_distinct", "SELECT o_custkey AS entity_id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS codes FROM orders GROUP BY 1")
def array_agg_distinct(v: Views) -> DataFrame:
    return v.contracts.groupBy(F.col("authority_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_set("acquisition_type")), ",").alias("codes"))


@query("pivot_filter_max", "SELECT o_custkey AS entity_id, coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
def pivot_filter_max(v: Views) -> DataFrame:
    top = lambda s: F.coalesce(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0)).alias(s.lower())
    return v.table("orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(*map(top, "FOP"))


@query("distinct_on_latest", "SELECT user_id, notice_id, kind FROM (SELECT user_id, event_id AS notice_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def distinct_on_latest(v: Views) -> DataFrame:
    return sinks.latest(v.notices.select("user_id", "state_date", "notice_id", "kind"), ["user_id"], "state_date", "notice_id").select("user_id", "notice_id", "kind")


@query("quantile_classes", f"WITH t AS (SELECT county, CAST(sum(closing) AS DOUBLE) AS total FROM {DA} d JOIN {ORGS} o ON o.entity_id = d.authority_id AND o.role = 'authority' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total) AS i, count(*) OVER () AS n FROM t), b AS (SELECT total FROM r JOIN (VALUES (1), (2), (3), (4)) k(k) ON i = (k * n) // 5 + 1) SELECT county, total, (SELECT count(*) FROM b WHERE b.total < t.total) AS class FROM t")
def quantile_classes(v: Views) -> DataFrame:
    per = v.facts.groupBy("authority_id").agg(F.sum("closing").alias("x"))
    places = v.organisations.where("role = 'authority'").select(F.col("entity_id").alias("authority_id"), "county")
    totals = per.join(places, "authority_id").groupBy("county").agg(F.sum("x").cast("double").alias("total"))
    bounds = serving.quantile_bounds(totals, "total")  # one row
    return totals.crossJoin(F.broadcast(bounds)).select("county", "total", serving.class_of(F.col("total"), F.col("bounds")).cast("long").alias("class"))


@query("max_normalized", "SELECT r_name, total, total / max(total) OVER () AS bar FROM (SELECT r_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def max_normalized(v: Views) -> DataFrame:
    n, r, c = v.table("nation"), v.table("region"), v.table("customer")
    t = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey).groupBy("r_name").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))
    top = t.agg(F.max("total").alias("top"))
    return t.crossJoin(F.broadcast(top)).select("r_name", "total", (F.col("total") / F.col("top")).alias("bar"))


@query("profiling_counters", "SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey % 10 = 0) AS missing, count(*) FILTER (WHERE o_custkey % 10 <> 0 AND o_orderstatus = 'F') AS valid FROM orders")
def profiling_counters(v: Views) -> DataFrame:
    o = v.table("orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderstatus")).alias("s"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("s") == "F").alias("valid"))


@query("split_attribution", f"SELECT supplier_id, count(*) AS n, {half_up_sql('sum(full_)')} AS total_full, {half_up_sql('sum(split)')} AS total_split FROM {PAIRS} GROUP BY 1")
def split_attribution(v: Views) -> DataFrame:
    g = _pairs(v).groupBy("supplier_id").agg(F.count("*").alias("n"), F.sum("full").alias("f"), F.sum("split").alias("s"))
    return g.select("supplier_id", "n", spend.half_up(F.col("f"), 2).alias("total_full"), spend.half_up(F.col("s"), 2).alias("total_split"))


@query("topk_role", f"WITH t AS (SELECT 'authority' AS role, authority_id AS entity_id, sum(closing) AS total FROM {DA} GROUP BY 2 UNION ALL SELECT 'supplier', supplier_id, sum(closing) FROM {DA} GROUP BY 2) SELECT role, rank, entity_id, CAST(total AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY total DESC NULLS LAST, entity_id) AS rank FROM t) WHERE rank <= 200")
def topk_role(v: Views) -> DataFrame:
    side = lambda role: v.facts.groupBy(F.col(f"{role}_id").alias("entity_id")).agg(F.sum("closing").alias("total")).withColumn("role", F.lit(role))
    return spend.top_by(side("authority").unionByName(side("supplier")), ["role"], "total", 200, "entity_id").select("role", big("rank"), "entity_id", dbl("total"))


@query("topk_partners", f"WITH p AS (SELECT authority_id AS a, supplier_id AS s, count(*) AS n, sum(closing) AS t FROM {DA} WHERE closing <= 100000 GROUP BY 1, 2), b AS (SELECT a AS entity_id, 'authority' AS role, s AS partner_id, n, t FROM p UNION ALL SELECT s, 'supplier', a, n, t FROM p) SELECT entity_id, role, partner_id, rank, n, CAST(t AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, role ORDER BY t DESC NULLS LAST, partner_id) AS rank FROM b) WHERE rank <= 5")
def topk_partners(v: Views) -> DataFrame:
    sides = spend.partners(v.facts.where("closing <= 100000"), "closing")
    return spend.top_by(sides, ["entity_id", "role"], "total", 5, "partner_id").select("entity_id", "role", "partner_id", big("rank"), "n", dbl("total"))


@query("page_offset", "SELECT o_orderkey AS contract_id, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(v: Views) -> DataFrame:
    return v.contracts.select("contract_id", dbl("value")).orderBy(F.desc_nulls_last("value"), "contract_id").offset(100).limit(50)


@query("sort_nulls_last", "SELECT contract_id, gap FROM (SELECT o_orderkey AS contract_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS gap FROM orders) ORDER BY gap ASC NULLS LAST, contract_id")
def sort_nulls_last(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("contract_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("gap"))
    return o.orderBy(F.asc_nulls_last("gap"), "contract_id")


@query("sort_multi", "SELECT p_brand AS brand, p_type AS kind, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, brand, kind LIMIT 40")
def sort_multi(v: Views) -> DataFrame:
    return v.table("part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand", "kind").limit(40)


@query("union_streams", f"SELECT kind, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM {STREAMS} GROUP BY 1")
def union_streams(v: Views) -> DataFrame:
    return _streams(v).groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("array_concat_cond", "SELECT user_id, array_to_string(list_concat(list_sort(list(DISTINCT event_type)), CASE WHEN count(*) > 110 THEN ['busy'] ELSE [] END), ',') AS codes FROM events GROUP BY 1")
def array_concat_cond(v: Views) -> DataFrame:
    g = v.notices.groupBy("user_id").agg(F.array_sort(F.collect_set("kind")).alias("own"), F.count("*").alias("n"))
    extra = F.when(F.col("n") > 110, F.array(F.lit("busy"))).otherwise(F.array().cast("array<string>"))
    return g.select("user_id", F.array_join(F.concat("own", extra), ",").alias("codes"))


@query("spend_by_type", f"SELECT 'award' AS kind, o_orderpriority AS acquisition_type, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 2 UNION ALL SELECT 'da', acquisition_type, count(*), CAST(sum(closing) AS DOUBLE) FROM {DA} GROUP BY 2")
def spend_by_type(v: Views) -> DataFrame:
    awards = v.contracts.select(F.lit("award").alias("kind"), "acquisition_type", "value")
    direct = v.table("lineitem").select(F.lit("da").alias("kind"), F.col("l_returnflag").alias("acquisition_type"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    return spend.by_type(awards.unionByName(direct)).select("kind", "acquisition_type", "n", dbl("total"))


@query("spend_by_division", f"SELECT 'da' AS kind, division, 'name of ' || division AS name, count(*) AS n, CAST(sum(closing) AS DOUBLE) AS total FROM {DA} GROUP BY 2")
def spend_by_division(v: Views) -> DataFrame:
    lines, parts = v.table("lineitem"), v.table("part")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.lit("da").alias("kind"), F.col("p_type").alias("division"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    names = parts.select(F.col("p_type").alias("division")).distinct().withColumn("name", F.concat(F.lit("name of "), "division"))
    return spend.by_division(rows, names).select("kind", "division", "name", "n", dbl("total"))


def _profile(v: Views, role: str) -> DataFrame:
    return spend.profiles(_pairs(v), role)


@query("profile_supplier", f"SELECT supplier_id AS entity_id, count(*) FILTER (WHERE src = 'contract') AS n_contracts, count(*) FILTER (WHERE src = 'da') AS n_das, {half_up_sql('sum(full_)')} AS total_full, {half_up_sql('sum(split)')} AS total_split, strftime(min(activity), '%Y-%m-%d %H:%M') AS first_activity, strftime(max(activity), '%Y-%m-%d %H:%M') AS last_activity FROM {PAIRS} GROUP BY 1")
def profile_supplier(v: Views) -> DataFrame:
    return _profile(v, "supplier").withColumns({c: spend.half_up(F.col(c), 2) for c in ("total_full", "total_split")})


@query("profile_authority", f"SELECT p.*, o.name, o.county FROM (SELECT authority_id AS entity_id, count(DISTINCT contract_id) AS n_contracts, count(*) FILTER (WHERE src = 'da') AS n_das, {half_up_sql('sum(split)')} AS total_full, {half_up_sql('sum(split)')} AS total_split, strftime(min(activity), '%Y-%m-%d %H:%M') AS first_activity, strftime(max(activity), '%Y-%m-%d %H:%M') AS last_activity FROM {PAIRS} GROUP BY 1) p LEFT JOIN {ORGS} o ON o.entity_id = p.entity_id AND o.role = 'authority'")
def profile_authority(v: Views) -> DataFrame:
    p = _profile(v, "authority").withColumns({c: spend.half_up(F.col(c), 2) for c in ("total_full", "total_split")})
    return p.join(v.organisations.where("role = 'authority'").select("entity_id", "name", "county"), "entity_id", "left")


@query("spend_by_region", f"SELECT county, role, count(*) AS n, {half_up_sql('sum(t)')} AS total FROM (SELECT entity_id, role, sum(split) AS t FROM (SELECT authority_id AS entity_id, 'authority' AS role, split FROM {PAIRS}) GROUP BY 1, 2 UNION ALL SELECT supplier_id, 'supplier', sum(full_) FROM {PAIRS} GROUP BY 1) JOIN {ORGS} USING (entity_id, role) WHERE county <> '' GROUP BY 1, 2")
def spend_by_region(v: Views) -> DataFrame:
    side = lambda role: _profile(v, role).withColumn("role", F.lit(role))
    both = side("authority").unionByName(side("supplier")).join(v.organisations, ["entity_id", "role"])
    return spend.by_region(both).withColumn("total", spend.half_up(F.col("total"), 2))


@query("entity_profile_rank", f"WITH p AS (SELECT authority_id AS entity_id, 'authority' AS role, sum(closing) AS total FROM {DA} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, entity_id) AS rank FROM p) SELECT p.entity_id, p.role, CAST(p.total AS DOUBLE) AS total, CASE WHEN r.rank <= 200 THEN r.rank END AS rank FROM p JOIN r USING (entity_id)")
def entity_profile_rank(v: Views) -> DataFrame:
    p = v.facts.groupBy(F.col("authority_id").alias("entity_id")).agg(F.sum("closing").alias("total")).withColumn("role", F.lit("authority"))
    tops = spend.top_by(p, ["role"], "total", 200, "entity_id")
    return serving.profile_with_rank(p, tops).select("entity_id", "role", dbl("total"), big("rank"))


@query("monthly", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(18,2)) <= 100000 GROUP BY 1")
def monthly(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_shipdate").alias("finalization"), F.col("l_extendedprice").cast("decimal(18,2)").alias("closing"))
    return serving.monthly(rows, 100_000).select("month", "n", dbl("total"))


@query("upsert_latest", "SELECT conv_id, role, turn, n FROM (SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS i FROM conversations) WHERE i = 1")
def upsert_latest(v: Views) -> DataFrame:
    rows = v.table("conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))
    return sinks.latest(rows, ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "n")


@query("upsert_partial", "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS listed, arg_max(event_id, event_id) FILTER (WHERE event_type = 'click') AS detailed FROM events GROUP BY 1")
def upsert_partial(v: Views) -> DataFrame:
    rows = v.notices.select("user_id", "notice_id", "kind", F.col("value").cast("double").alias("listed"), F.col("notice_id").alias("detailed"))
    return sinks.latest_by_part(rows, ["user_id"], {"list": (F.col("kind") == "view", ["listed"]), "detail": (F.col("kind") == "click", ["detailed"])}, "notice_id")


@query("quarantine_split", "SELECT event_type AS kind, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 50) AS good, count(*) FILTER (WHERE NOT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) < 50, false)) AS bad FROM events GROUP BY 1")
def quarantine_split(v: Views) -> DataFrame:
    rows = v.notices.withColumn("k", F.get_json_object("evidence", "$.k").try_cast("long")).withColumnRenamed("evidence", "payload")
    good, bad = sinks.quarantine(rows, F.col("k") >= 50, F.lit("k out of range"))
    both = good.select("kind", F.lit(1).alias("g")).unionByName(bad.select("kind", F.lit(0).alias("g")))
    return both.groupBy("kind").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


@query("run_ledger", "SELECT event_type AS source, count(*) AS fetched, CASE WHEN event_type <> 'error' THEN CAST(count(*) + 2 AS BIGINT) END AS reported, CASE WHEN event_type <> 'error' THEN CAST(2 AS BIGINT) END AS deviation FROM events GROUP BY 1")
def run_ledger(v: Views) -> DataFrame:
    runs = v.notices.groupBy(F.col("kind").alias("source")).agg(F.count("*").alias("fetched"))
    return sinks.with_deviation(runs.withColumn("reported", F.when(F.col("source") != "error", F.col("fetched") + 2)))
