"""Red flags of direct acquisitions under dated thresholds, the composite index, and their read models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import gap_seconds
from ..session import stored
from .spend import half_up, top_by

METHODOLOGY = "rf-2020.1"
#: Flags that can apply to an organisation in each role.
APPLICABLE = {"authority": 5, "supplier": 4}


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; the defaults are those in force before any is recorded. works: the division of works."""

    max_plausible: float = 2_000_000
    goods: float = 132_519
    works: float = 441_730
    rapid_hours: float = 1.0
    round_floor: float = 0.9
    split_count: int = 3
    top_supplier: float = 0.6
    min_suppliers: int = 3
    min_total: float = 100_000
    top_authority: float = 0.85
    min_supplier_total: float = 50_000
    december: float = 0.35
    min_year_total: float = 100_000
    works_division: str = "45"


def thresholds_at(thresholds: DataFrame, day: Column | None = None) -> DataFrame:
    """(key, value_num): the value of each key that was in force on a day (from valid_from until before valid_to); without a
    day the latest recorded one."""
    t = thresholds if day is None else thresholds.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
    return t.groupBy("key").agg(F.max_by("value_num", "valid_from").alias("value_num"))


def with_threshold(facts: DataFrame, at: str, thresholds: DataFrame, key: str, name: str) -> DataFrame:
    """facts with the value of a key in force at each row's own day (null before the first). The few periods of one
    key are gathered into one row, so the facts are neither shuffled nor multiplied."""
    own = thresholds.where(F.col("key") == key).agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "value_num"))).alias("_periods"))
    day = F.col(at)
    hits = F.filter("_periods", lambda p: (p.valid_from <= day) & (p.valid_to.isNull() | (day < p.valid_to)))
    return facts.crossJoin(F.broadcast(own)).withColumn(name, F.try_element_at(hits, F.lit(-1)).value_num).drop("_periods")


def _ceiling(limits: Limits) -> Column:
    return F.when(F.col("division") == limits.works_division, F.lit(float(limits.works))).otherwise(F.lit(float(limits.goods)))


def _money(name: str = "closing") -> Column:
    return F.col(name).cast("double")


def _plausible(da: DataFrame, limits: Limits) -> DataFrame:
    return da.where(_money() <= limits.max_plausible)


def _gap() -> Column:
    return gap_seconds(F.col("publication"), F.col("finalization"))


def _fine(limits: Limits) -> Column:
    return F.coalesce(_money() <= limits.max_plausible, F.lit(False))


def is_rapid(limits: Limits) -> Column:
    """Whether an acquisition was finalized within hours of publication."""
    return F.coalesce((F.col("finalization") >= F.col("publication")) & (F.col("closing").isNull() | _fine(limits)) & (_gap() < limits.rapid_hours * 3600), F.lit(False))


def is_round(limits: Limits) -> Column:
    """Whether an acquisition closes just below its ceiling."""
    return F.coalesce(_fine(limits) & (_money() > 0) & (_money() >= F.lit(float(limits.round_floor)) * _ceiling(limits)) & (_money() < _ceiling(limits)), F.lit(False))


def _rapid_severity(limits: Limits) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _gap() / 3600 / F.lit(float(limits.rapid_hours))))


def flag_codes(limits: Limits) -> Column:
    """The sorted codes that an acquisition's own row sets, null if none."""
    codes = F.array_compact(F.array(F.when(is_rapid(limits), F.lit("da_rapid")), F.when(is_round(limits), F.lit("da_round"))))
    return F.when(F.size(codes) > 0, codes)


def rapid(da: DataFrame, limits: Limits) -> DataFrame:
    """Acquisitions finalized within hours of publication; severity falls with the gap."""
    return da.where(is_rapid(limits)).withColumns({"flag_code": F.lit("da_rapid"), "severity": _rapid_severity(limits), "minutes": F.round(_gap() / 60).cast("long")})


def round_value(da: DataFrame, limits: Limits) -> DataFrame:
    """Acquisitions that close just below their ceiling."""
    hit = da.where(is_round(limits)).withColumn("ceiling", _ceiling(limits))
    return hit.withColumns({"flag_code": F.lit("da_round"), "severity": F.least(F.lit(1.0), _money() / F.col("ceiling"))})


def pair_years(da: DataFrame, limits: Limits) -> DataFrame:
    """Plausible acquisitions summed by authority, supplier and year (each may be null): part and n, december, and split_n, split_total and
    ceiling of those that stay below the ceiling. All rules on pairs, organisations and years follow from it."""
    below = (_money() > 0) & (_money() < _ceiling(limits))
    nothing = F.lit(0).cast("decimal(18,2)")
    return _plausible(da, limits).groupBy("authority_id", "supplier_id", F.year("finalization").alias("year")).agg(
        F.sum("closing").alias("part"), F.count("*").alias("n"), F.sum(F.when(F.month("finalization") == 12, F.col("closing")).otherwise(nothing)).alias("december"),
        F.count_if(below).alias("split_n"), F.sum(F.when(below, F.col("closing"))).alias("split_total"), F.max(F.when(below, _ceiling(limits))).alias("ceiling"),
    )


def split(da: DataFrame, limits: Limits) -> DataFrame:
    """Pairs that stay below the ceiling each time but pass it together within a year."""
    return split_of(pair_years(da, limits), limits)


def split_of(years: DataFrame, limits: Limits) -> DataFrame:
    g = years.where("authority_id is not null and supplier_id is not null and year is not null").select("authority_id", "supplier_id", "year", F.col("split_n").alias("n"), F.col("split_total").alias("total"), "ceiling")
    g = g.where((F.col("n") >= limits.split_count) & (_money("total") > F.col("ceiling")))
    return g.withColumns({"flag_code": F.lit("da_split"), "severity": F.least(F.lit(1.0), _money("total") / F.col("ceiling") / 3)})


def pair_totals(da: DataFrame, limits: Limits) -> DataFrame:
    """Sums of plausible acquisitions between two organisations; concentration, dependence and partners share it."""
    return _plausible(da, limits).where("authority_id is not null and supplier_id is not null").groupBy("authority_id", "supplier_id").agg(F.sum("closing").alias("part"), F.count("*").alias("n"))


def pair_totals_of(years: DataFrame) -> DataFrame:
    return years.where("authority_id is not null and supplier_id is not null").groupBy("authority_id", "supplier_id").agg(F.sum("part").cast("decimal(28,2)").alias("part"), F.sum("n").alias("n"))


def captured(pairs: DataFrame, limits: Limits) -> DataFrame:
    """Authorities of which one supplier takes most."""
    x = _money("part")
    g = pairs.groupBy("authority_id").agg(F.sum("part").alias("total"), F.count("*").alias("suppliers"), F.max("part").alias("top"), F.sum(x * x).alias("squares"))
    share = F.try_divide(_money("top"), _money("total"))
    g = g.where((_money("total") >= limits.min_total) & (F.col("suppliers") >= limits.min_suppliers) & (share >= limits.top_supplier))
    return g.withColumns({"flag_code": F.lit("da_concentration"), "severity": F.least(F.lit(1.0), share), "hhi": half_up(F.try_divide(F.col("squares"), _money("total") * _money("total")))})


def dependent(pairs: DataFrame, limits: Limits) -> DataFrame:
    """Suppliers that live off one authority."""
    g = pairs.groupBy("supplier_id").agg(F.sum("part").alias("total"), F.count("*").alias("authorities"), F.max("part").alias("top"))
    share = F.try_divide(_money("top"), _money("total"))
    g = g.where((_money("total") >= limits.min_supplier_total) & (share >= limits.top_authority))
    return g.withColumns({"flag_code": F.lit("da_dependence"), "severity": F.least(F.lit(1.0), share)})


def year_end(da: DataFrame, limits: Limits) -> DataFrame:
    """Authorities that spend much of a year in December."""
    dated = _plausible(da, limits).groupBy("authority_id", F.year("finalization").alias("year")).agg(F.sum("closing").alias("part"), F.sum(F.when(F.month("finalization") == 12, F.col("closing")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("december"))
    return year_end_of(dated, limits)


def year_end_of(years: DataFrame, limits: Limits) -> DataFrame:
    dated = years.where("authority_id is not null and year is not null")
    g = dated.groupBy("authority_id", "year").agg(F.sum("part").cast("decimal(28,2)").alias("total"), F.sum("december").cast("decimal(28,2)").alias("december"))
    share = F.try_divide(_money("december"), _money("total"))
    g = g.where((_money("total") >= limits.min_year_total) & (share >= limits.december))
    return g.withColumns({"flag_code": F.lit("da_year_end"), "severity": F.least(F.lit(1.0), share)})


def all_flags(da: DataFrame, limits: Limits) -> DataFrame:
    """Every flag in one shape: subject_type, subject_id, partner_id, flag_code, period, severity, evidence (JSON), methodology.

    A flag of an acquisition has its key da_id (a string) as subject; da needs such a column. The acquisitions are read twice: once for
    the flags of their own rows, once for the sums by pair and year that the other rules share (kept in the shared folder)."""
    text = lambda c: F.col(c).cast("string")
    years = stored(pair_years(da, limits), "pair-years")
    pairs = pair_totals_of(years)
    told = lambda **evidence: F.to_json(F.struct(*(v.alias(k) for k, v in evidence.items())), {"ignoreNullFields": "false"})
    tail = [F.lit(METHODOLOGY).alias("methodology")]

    kind = F.when(F.col("division") == limits.works_division, "lucrari").otherwise("produse/servicii")
    own = F.array_compact(F.array(
        F.when(is_rapid(limits), F.struct(F.lit("da_rapid").alias("flag_code"), _rapid_severity(limits).alias("severity"), told(minutes=F.round(_gap() / 60).cast("long"), closing=F.col("closing")).alias("evidence"))),
        F.when(is_round(limits), F.struct(F.lit("da_round").alias("flag_code"), F.least(F.lit(1.0), _money() / _ceiling(limits)).alias("severity"), told(closing=F.col("closing"), ceiling=_ceiling(limits), type=kind).alias("evidence"))),
    ))
    rows = da.select("da_id", "finalization", F.explode(own).alias("f"))
    out = rows.select(F.lit("da").alias("subject_type"), text("da_id").alias("subject_id"), F.lit(None).cast("string").alias("partner_id"), "f.flag_code", F.date_format("finalization", "yyyy").alias("period"), "f.severity", "f.evidence", *tail)

    def shaped(df: DataFrame, kind: str, subject: str, partner: str | None, period: Column, **evidence: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("subject_type"), text(subject).alias("subject_id"), (text(partner) if partner else F.lit(None).cast("string")).alias("partner_id"), "flag_code", period.alias("period"), "severity", told(**evidence).alias("evidence"), *tail)

    share = lambda c: half_up(F.try_divide(_money(c), _money("total")))
    c, every = F.col, F.lit("all")
    out = out.unionByName(shaped(split_of(years, limits), "pair", "authority_id", "supplier_id", text("year"), year=c("year"), count=c("n"), total=c("total"), ceiling=c("ceiling")))
    out = out.unionByName(shaped(captured(pairs, limits), "authority", "authority_id", None, every, total=c("total"), suppliers=c("suppliers"), top_supplier_pct=share("top"), hhi=c("hhi")))
    out = out.unionByName(shaped(dependent(pairs, limits), "supplier", "supplier_id", None, every, total=c("total"), authorities=c("authorities"), top_authority_pct=share("top")))
    return out.unionByName(shaped(year_end_of(years, limits), "authority", "authority_id", None, text("year"), year=c("year"), total=c("total"), december=c("december"), december_pct=share("december")))


def flag_totals(da: DataFrame, limits: Limits) -> DataFrame:
    """(flag_code, n): how many flags of each code there are, 0 where none; those of single rows are counted without writing them."""
    years = stored(pair_years(da, limits), "pair-years")
    pairs = pair_totals_of(years)
    rows = da.agg(F.count_if(is_rapid(limits)).alias("a"), F.count_if(is_round(limits)).alias("b")).select(F.explode(F.create_map(F.lit("da_rapid"), "a", F.lit("da_round"), "b")).alias("flag_code", "n"))
    sums = {"da_split": split_of(years, limits), "da_concentration": captured(pairs, limits), "da_dependence": dependent(pairs, limits), "da_year_end": year_end_of(years, limits)}
    for code, g in sums.items():
        rows = rows.unionByName(g.agg(F.count("*").alias("n")).withColumn("flag_code", F.lit(code)))
    return rows


def risk_index(da: DataFrame, limits: Limits) -> DataFrame:
    """(entity_id, role, n, total, codes, cri): each organisation's triggered flags and their share of the applicable ones.

    da_rapid and da_round count for an organisation with at least 5 acquisitions where more than 25 % and 10 % carry them. The acquisitions are
    read twice: each row counts for both its roles in one aggregate, and sums by pair and year (kept in the shared folder) serve the other rules."""
    rows = da.select(_fine(limits).alias("fine"), is_rapid(limits).alias("quick"), is_round(limits).alias("near"), "closing", F.explode(F.array(*(F.struct(F.col(f"{r}_id").alias("entity_id"), F.lit(r).alias("role")) for r in APPLICABLE))).alias("side"))
    bases = rows.where("side.entity_id is not null").groupBy("side.entity_id", "side.role").agg(
        F.count_if("fine").alias("n"), F.sum(F.when(F.col("fine"), F.col("closing"))).alias("total"), F.count_if("quick").alias("rapid"), F.count_if("near").alias("round")
    ).where("n > 0")
    years = stored(pair_years(da, limits), "pair-years")
    pairs, cut = pair_totals_of(years), split_of(years, limits)
    code = lambda df, col, role: df.select(F.col(col).alias("entity_id"), F.lit(role).alias("role"), "flag_code")
    found = code(captured(pairs, limits), "authority_id", "authority").unionByName(code(dependent(pairs, limits), "supplier_id", "supplier"))
    found = found.unionByName(code(year_end_of(years, limits), "authority_id", "authority")).unionByName(code(cut, "authority_id", "authority")).unionByName(code(cut, "supplier_id", "supplier"))
    codes = found.groupBy("entity_id", "role").agg(F.array_sort(F.collect_set("flag_code")).alias("own"))
    none = F.array().cast("array<string>")
    often = lambda c, share, name: F.when((F.col("n") >= 5) & (F.col(c) / F.col("n") > share), F.array(F.lit(name))).otherwise(none)
    out = bases.join(codes, ["entity_id", "role"], "left")
    out = out.withColumn("codes", F.concat(F.coalesce("own", none), often("rapid", 0.25, "da_rapid"), often("round", 0.10, "da_round")))
    applicable = F.when(F.col("role") == "authority", APPLICABLE["authority"]).otherwise(APPLICABLE["supplier"])
    return out.select("entity_id", "role", "n", "total", "codes", half_up(F.size("codes") / applicable).alias("cri"))


def band(cri: Column) -> Column:
    """Words for an index: high from 0.6, medium from 0.3, low above 0."""
    return F.when(cri >= 0.6, "high").when(cri >= 0.3, "medium").when(cri > 0, "low").otherwise("none")


def instances(flags: DataFrame, da: DataFrame, names: DataFrame, k: int = 500) -> DataFrame:
    """Browsable flags: all of organisations and pairs with their names, and the k most severe acquisitions of each code.

    names: (entity_id, role, name, county), entity_id as text. The total of the former comes from their evidence."""
    side = lambda role, p: names.where(F.col("role") == role).select(F.col("entity_id").alias(p + "_id"), F.col("name").alias(p + "_name"), F.col("county").alias(p + "_county"))
    own = flags.where("subject_type <> 'da'").withColumn("total", F.get_json_object("evidence", "$.total").try_cast("double"))
    seller = F.col("subject_type") == "supplier"
    own = own.withColumns({"authority_id": F.when(~seller, F.col("subject_id")), "supplier_id": F.when(seller, F.col("subject_id")).otherwise(F.col("partner_id"))})
    top = top_by(flags.where("subject_type = 'da'"), ["flag_code"], "severity", k, "subject_id")
    facts = da.select(F.col("da_id").alias("subject_id"), F.col("authority_id").cast("string").alias("authority_id"), F.col("supplier_id").cast("string").alias("supplier_id"), F.col("closing").cast("double").alias("total"))
    cols = ["flag_code", "subject_type", "authority_id", "supplier_id", "severity", "total", "period", "evidence"]
    both = own.select(*cols).unionByName(top.join(facts, "subject_id").select(*cols))
    return both.join(side("authority", "authority"), "authority_id", "left").join(side("supplier", "supplier"), "supplier_id", "left")


def evidence_line(code: Column, evidence: Column) -> Column:
    """A flag's evidence in one line for people; empty for an unknown code."""
    get = lambda k: F.get_json_object(evidence, "$." + k)
    whole = lambda k: F.translate(F.format_number(F.round(get(k).try_cast("double")), 0), ",", ".")
    percent = lambda k: F.floor(get(k).try_cast("double") * 100 + 0.5).cast("string")
    lines = {
        "da_split": F.concat(get("count"), F.lit(" achiziții în "), get("year"), F.lit(", prag "), whole("ceiling"), F.lit(" lei")),
        "da_concentration": F.concat(F.lit("top furnizor "), percent("top_supplier_pct"), F.lit("% · HHI "), get("hhi"), F.lit(" · "), get("suppliers"), F.lit(" furnizori")),
        "da_dependence": F.concat(percent("top_authority_pct"), F.lit("% dintr-o singură autoritate · "), get("authorities"), F.lit(" autorități")),
        "da_year_end": F.concat(percent("december_pct"), F.lit("% în decembrie "), get("year")),
        "da_rapid": F.concat(F.lit("finalizat în "), get("minutes"), F.lit(" minute")),
        "da_round": F.concat(whole("closing"), F.lit(" din prag "), whole("ceiling"), F.lit(" lei")),
    }
    out = F.lit("")
    for name, line in lines.items():
        out = F.when(code == name, line).otherwise(out)
    return out
