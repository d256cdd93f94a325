"""Payloads to typed facts, organisations as a set operation, and name suggestions from shared trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_LABEL = "struct<text: string>"
_WINNER = f"struct<entityId: long, fiscalNumber: string, name: string, address: struct<officialName: string, county: {_LABEL}, nutsCodeItem: {_LABEL}>>"
#: Payload shapes by endpoint version; unknown fields are tolerated, only the natural key is mandatory.
SCHEMAS = {
    "tender-list:v1": f"cNoticeId long, noticeNo string, contractTitle string, contractingAuthorityNameAndFN string, cpvCodeAndName string, estimatedValueRon decimal(18,2), noticeStateDate string, sysNoticeState {_LABEL}, sysAcquisitionContractType {_LABEL}, sysProcedureType {_LABEL}, isOnline boolean, hasLots boolean",
    "award-list:v1": f"caNoticeId long, noticeNo string, contractTitle string, contractingAuthorityNameAndFN string, cpvCodeAndName string, ronContractValue decimal(18,2), lowestOfferValue decimal(18,2), highestOfferValue decimal(18,2), noticeStateDate string, sysNoticeState {_LABEL}, sysAcquisitionContractType {_LABEL}",
    "award-contracts:v1": f"caNoticeId long, items array<struct<caNoticeContractId: long, caNoticeId: long, contractNo: string, contractTitle: string, contractDate: string, contractValue: decimal(18,2), defaultCurrencyContractValue: decimal(18,2), lotsCaption: string, currency: {_LABEL}, winner: {_WINNER}, winners: array<{_WINNER}>>>",
    "da-list:v1": f"directAcquisitionId long, uniqueIdentificationCode string, contractingAuthority string, supplier string, cpvCode string, estimatedValueRon decimal(18,2), closingValue decimal(18,2), publicationDate string, finalizationDate string, sysDirectAcquisitionState {_LABEL}",
    "da-detail:v1": f"directAcquisitionID long, uniqueIdentificationCode string, contractingAuthorityID long, supplierId long, sysAcquisitionContractType {_LABEL}, sysDirectAcquisitionState {_LABEL}, cpvCode struct<text: string, localeKey: string>, estimatedValue decimal(18,2), closingValue decimal(18,2), publicationDate string, finalizationDate string, directAcquisitionItems array<struct<directAcquisitionItemID: long, catalogItemName: string, itemQuantity: decimal(18,4), itemMeasureUnit: string, catalogItemPrice: decimal(18,2), itemClosingPrice: decimal(18,2), cpvCode: struct<text: string, localeKey: string>>>",
}
KEYS = {"tender-list:v1": "cNoticeId", "award-list:v1": "caNoticeId", "award-contracts:v1": "caNoticeId", "da-list:v1": "directAcquisitionId", "da-detail:v1": "directAcquisitionID"}


def parsed(raw: DataFrame, endpoint: str) -> DataFrame:
    """raw rows (…, endpoint_version, payload) of an endpoint with the typed payload p; null p.<key> means quarantine."""
    typed = F.from_json("payload", SCHEMAS[endpoint], {"mode": "PERMISSIVE"})
    return raw.where(F.col("endpoint_version") == endpoint).withColumn("p", typed)


def natural_key(endpoint: str) -> Column:
    return F.col("p")[KEYS[endpoint]]


def contracts_of(award_contracts: DataFrame) -> DataFrame:
    """Contract rows of parsed award-contracts payloads, with their winners (the single winner where no list is given)."""
    c = award_contracts.select("raw_id", F.posexplode("p.items").alias("place", "c")).where("c.caNoticeContractId is not null")
    winners = F.when(F.size("c.winners") > 0, F.col("c.winners")).when(F.col("c.winner").isNotNull(), F.array("c.winner"))
    return c.select(
        "raw_id", "place", F.col("c.caNoticeId").alias("ca_notice_id"), F.col("c.caNoticeContractId").alias("contract_id"), F.col("c.contractNo").alias("contract_no"), F.col("c.contractTitle").alias("title"),
        F.coalesce("c.defaultCurrencyContractValue", "c.contractValue").alias("value"), F.col("c.currency.text").alias("currency"), F.try_to_timestamp("c.contractDate").alias("contract_date"), F.col("c.lotsCaption").alias("lots_caption"), winners.alias("winners"),
    )


def winners_of(contracts: DataFrame) -> DataFrame:
    """(contract_id, source_id, fiscal_number, name), each winner once."""
    w = contracts.select("contract_id", F.explode("winners").alias("w"))
    return w.select("contract_id", F.col("w.entityId").alias("source_id"), F.col("w.fiscalNumber").alias("fiscal_number"), F.col("w.name").alias("name")).distinct()


def notices_of(parsed_rows: DataFrame, endpoint: str) -> DataFrame:
    """Header columns of parsed tender or award lists; the organisation string is split into code and name."""
    award = endpoint.startswith("award")
    value = F.col("p.ronContractValue" if award else "p.estimatedValueRon")
    org = F.col("p.contractingAuthorityNameAndFN")
    return parsed_rows.select(
        "raw_id", natural_key(endpoint).alias("notice_id"), F.col("p.noticeNo").alias("notice_no"), F.col("p.contractTitle").alias("title"), X.fiscal_code(X.entity_code(org)).alias("authority_code"), X.entity_name(org).alias("authority_name"),
        X.cpv_code(F.col("p.cpvCodeAndName")).alias("cpv_code"), F.col("p.cpvCodeAndName").alias("cpv_raw"), value.alias("value"), F.try_to_timestamp("p.noticeStateDate").alias("state_date"), F.col("p.sysNoticeState.text").alias("state"), F.col("p.sysAcquisitionContractType.text").alias("acquisition_type"),
    )


def acquisitions_of(parsed_rows: DataFrame, endpoint: str) -> DataFrame:
    """Header columns of parsed acquisition lists and details in one shape; each kind leaves null what it does not carry."""
    detail = endpoint.startswith("da-detail")
    none = lambda kind: F.lit(None).cast(kind)
    cpv = X.cpv_of(F.col("p.cpvCode.text"), F.col("p.cpvCode.localeKey")) if detail else X.cpv_code(F.col("p.cpvCode"))
    return parsed_rows.select(
        "raw_id", F.lit("detail" if detail else "list").alias("kind"), natural_key(endpoint).alias("da_id"), F.col("p.uniqueIdentificationCode").alias("da_code"),
        (none("string") if detail else F.col("p.contractingAuthority")).alias("authority"), (none("string") if detail else F.col("p.supplier")).alias("supplier"),
        cpv.alias("cpv_code"), (F.coalesce("p.cpvCode.localeKey", "p.cpvCode.text") if detail else F.col("p.cpvCode")).alias("cpv_raw"), F.col("p.sysDirectAcquisitionState.text").alias("state"), F.col("p.estimatedValue" if detail else "p.estimatedValueRon").alias("estimated"), F.col("p.closingValue").alias("closing"),
        F.try_to_timestamp("p.publicationDate").alias("publication"), F.try_to_timestamp("p.finalizationDate").alias("finalization"),
        (F.col("p.sysAcquisitionContractType.text") if detail else none("string")).alias("acquisition_type"),
    )


def items_of(details: DataFrame, units: DataFrame) -> DataFrame:
    """Line items of parsed acquisition details; a unit's canonical form and factor where the unit map has its key."""
    i = details.select("raw_id", F.col("p.directAcquisitionID").alias("da_id"), F.explode("p.directAcquisitionItems").alias("i")).where("i.directAcquisitionItemID is not null")
    i = i.select("raw_id", "da_id", F.col("i.directAcquisitionItemID").alias("item_id"), F.col("i.catalogItemName").alias("name"), F.col("i.itemQuantity").alias("quantity"), F.col("i.itemMeasureUnit").alias("unit_raw"), F.col("i.itemClosingPrice").alias("price"), X.cpv_of(F.col("i.cpvCode.text"), F.col("i.cpvCode.localeKey")).alias("cpv_code"))
    return with_unit(i, "unit_raw", units)


def with_unit(rows: DataFrame, raw: str, units: DataFrame) -> DataFrame:
    """rows with unit and factor of units (pattern, unit, factor) whose pattern is the raw unit's key; the raw text stays."""
    u = units.select(F.col("pattern").alias("_key"), "unit", "factor")
    return rows.withColumn("_key", X.unit_key(F.col(raw))).join(u, "_key", "left").drop("_key")


def with_cpv(rows: DataFrame, raw: str, catalog: DataFrame) -> DataFrame:
    """rows with cpv_code and cpv_valid: whether the catalog (code) knows the code that leads a string; null codes are null."""
    c = rows.withColumn("_code", X.cpv_code(F.col(raw))).join(catalog.select(F.col("code").alias("_known")).distinct(), F.col("_code") == F.col("_known"), "left")
    return c.withColumns({"cpv_valid": F.when(F.col("_code").isNotNull(), F.col("_known").isNotNull()), "cpv_code": F.col("_known")}).drop("_code", "_known")


def with_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (cpv_code, cpv_raw, …) with cpv_valid: whether the catalog (code) knows the code; unknown codes become null, rows without a raw code
    have no verdict."""
    known = catalog.select(F.col("code").alias("_known")).distinct()
    out = rows.join(known, F.col("cpv_code") == F.col("_known"), "left")
    return out.withColumns({"cpv_valid": F.when(F.col("cpv_raw").isNotNull(), F.col("_known").isNotNull()), "cpv_code": F.col("_known")}).drop("_known")


def resolve_organisations(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organisations, conflicts) of mentions (ord, namespace, source_id, code_raw, name, county, seen_at).

    An organisation is named by a key: for a source id, the valid fiscal code of the first mention that carries one and whose
    code no earlier-met id owns; else the id itself; without an id, the valid code; else a hash of what was written. Where
    one code leads several ids, the ids are one organisation. A later, different valid code of an id is a conflict and is never merged; names
    never merge. Record-at-a-time resolution may differ where an id meets its code only after other ids took it."""
    return organisations_of(named_mentions(mentions))


def named_mentions(mentions: DataFrame) -> DataFrame:
    """mentions with code, valid, owned (the code of their source id) and entity_key."""
    m = mentions.withColumn("code", X.fiscal_code(F.col("code_raw")))
    m = m.withColumn("valid", X.fiscal_code_valid(F.col("code")))
    ids = m.where("source_id is not null").groupBy("namespace", "source_id").agg(F.min_by("code", F.when(F.col("valid"), F.col("ord"))).alias("owned"))
    named = m.join(ids, ["namespace", "source_id"], "left")
    return named.withColumn("entity_key", named_key(F.col("owned")))


def named_key(owned: Column) -> Column:
    """What names the organisation of a mention (namespace, source_id, code, valid, code_raw, name), given the code that its id owns."""
    return (
        F.when(owned.isNotNull(), F.concat(F.lit("code:"), owned))
        .when(F.col("source_id").isNotNull(), F.concat_ws(":", F.lit("id"), F.col("namespace"), F.col("source_id").cast("string")))
        .when(F.col("valid"), F.concat(F.lit("code:"), "code"))
        .otherwise(F.concat(F.lit("raw:"), F.sha2(F.concat_ws(" ", "code_raw", "name"), 256)))
    )


def organisations_of(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organisations, conflicts) of named_mentions()."""
    first = lambda c, cond=None: F.min_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("ord")))
    organisations = named.groupBy("entity_key").agg(
        F.coalesce(first("owned"), first("code", F.col("valid"))).alias("code"),
        F.bool_or("valid").alias("code_valid"),
        first("name").alias("name"),
        first("county").alias("county"),
        F.array_sort(F.collect_set("code_raw")).alias("code_variants"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )
    organisations = organisations.withColumn("entity_id", F.xxhash64("entity_key"))
    conflicts = named.where("source_id is not null and valid and code <> owned").select("namespace", "source_id", "owned", F.col("code").alias("other")).distinct()
    return organisations, conflicts


def trigram_pairs(names: DataFrame, least: float = 0.55, settled: Column | None = None) -> DataFrame:
    """(a, b, similarity) of names (id, name) with a < b whose trigram sets have a Jaccard similarity of at least `least`; with
    settled, a condition on names, pairs of which both meet it are never made.

    Exact: sets that similar share one of their n - ceil(least * n) + 1 rarest trigrams, so only those meet in the join; sizes
    must fit too. Candidates are then compared whole."""
    done = F.lit(False) if settled is None else F.coalesce(settled, F.lit(False))
    sets = names.select("id", X.trigrams(F.col("name")).alias("t"), done.alias("done")).where(F.size("t") > 0).withColumn("n", F.size("t"))
    each = sets.select("id", "n", "done", F.explode("t").alias("g"))
    rare = each.groupBy("g").agg(F.count("*").alias("df"))
    ranked = each.join(rare, "g").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("df", "g")))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).select("id", "n", "done", "g")
    side = lambda p: prefix.select(F.col("id").alias(p), F.col("n").alias("n" + p), F.col("done").alias("done_" + p), "g")
    met = side("a").join(side("b"), "g").where("a < b and not (done_a and done_b)").where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")).select("a", "b").distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("t").alias("x")), sets.select(F.col("id").alias("b"), F.col("t").alias("y"))
    both = met.join(x, "a").join(y, "b")
    sim = F.size(F.array_intersect("x", "y")).cast("double") / F.size(F.array_union("x", "y"))
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= least)


def name_suggestions(entities: DataFrame, least: float = 0.55, strong: float = 0.85) -> DataFrame:
    """Pairs of organisations (id, name normalized, code_valid) to review: similar names of which at least one lacks a valid
    code, unless both carry different ordinals ("nr 4", "nr 5"). Never a merge."""
    pairs = trigram_pairs(entities, least, F.col("code_valid"))
    side = lambda p: entities.select(F.col("id").alias(p), X.first_ordinal(F.col("name")).alias(p + "_nr"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.where(F.coalesce(F.col("a_nr") == F.col("b_nr"), F.lit(True)))
    return p.select("a", "b", "similarity", F.when(F.col("similarity") >= strong, "strong").otherwise("weak").alias("band"))


def changed(incoming: DataFrame, archived: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """incoming rows that were archived before with another state (null-aware) in their latest version."""
    last = archived.groupBy(key).agg(F.max_by(state, order).alias("_last"), F.lit(True).alias("_seen"))
    both = incoming.join(last, key)
    return both.where(~F.col(state).eqNullSafe(F.col("_last"))).drop("_last", "_seen")
