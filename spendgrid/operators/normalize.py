"""The silver build: archived payloads to typed, resolved, last-writer-wins tables, one DataFrame job for each kind of payload.

Record-at-a-time loading becomes a replay: every record of an archive is parsed, what does not parse goes to quarantine, organisations
are resolved over all mentions at once, and the last record of each natural key wins, list before detail."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored
from . import silver, sinks

#: Kinds of payloads in the order in which they are loaded: lists before details.
ORDER = ("tender-list:v1", "award-list:v1", "award-contracts:v1", "da-list:v1", "da-detail:v1")
UNKNOWN_NAME = "(necunoscut)"


@dataclass
class Silver:
    """What a build gives: tables by name, rows that did not parse, the cursor of each kind, and counts."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    quarantine: DataFrame | None = None
    cursors: DataFrame | None = None
    report: DataFrame | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ord(kind: str, place: Column, part: Column | None = None) -> Column:
    """A mention's turn: kind, record, place in the record, and part of what stands there."""
    return F.struct(F.lit(ORDER.index(kind)).alias("kind"), F.col("raw_id").alias("record"), place.cast("int").alias("place"), (part if part is not None else F.lit(0)).cast("int").alias("part"))


def _mentions(parsed: Mapping[str, DataFrame]) -> DataFrame:
    """(ord, namespace, source_id, code_raw, name, county, seen_at) of every organisation that a record names."""
    text, none = "string", lambda t: F.lit(None).cast(t)

    def by_string(kind: str, namespace: str, column: str, seen: Column, place: int = 0) -> DataFrame:
        org = F.col(column)
        rows = parsed[kind].where(org.isNotNull() & (org != ""))
        return rows.select(_ord(kind, F.lit(place)).alias("ord"), F.lit(namespace).alias("namespace"), none("long").alias("source_id"), X.entity_code(org).alias("code_raw"), X.entity_name(org).alias("name"), none(text).alias("county"), seen.alias("seen_at"))

    stamp = lambda c: F.try_to_timestamp(F.col(c))
    out = [by_string(k, "authority", "p.contractingAuthorityNameAndFN", stamp("p.noticeStateDate")) for k in ("tender-list:v1", "award-list:v1") if k in parsed]
    if "award-contracts:v1" in parsed:
        w = winner_mentions(silver.contracts_of(parsed["award-contracts:v1"]))
        out.append(w.select("ord", F.lit("winner").alias("namespace"), "source_id", F.col("fiscal_number").alias("code_raw"), "name", "county", F.col("contract_date").alias("seen_at")))
    if "da-list:v1" in parsed:
        seen = F.coalesce(stamp("p.finalizationDate"), stamp("p.publicationDate"))
        out += [by_string("da-list:v1", "authority", "p.contractingAuthority", seen, 0), by_string("da-list:v1", "supplier", "p.supplier", seen, 1)]
    return _union(out)


def winner_mentions(contracts: DataFrame) -> DataFrame:
    """contracts with one row for each winner: ord, source_id, fiscal_number, name, county."""
    w = contracts.select("raw_id", "contract_id", "contract_date", "place", F.posexplode("winners").alias("i", "w"))
    return w.select(_ord("award-contracts:v1", F.col("place"), F.col("i")).alias("ord"), "raw_id", "contract_id", "contract_date", F.col("w.entityId").alias("source_id"), F.col("w.fiscalNumber").alias("fiscal_number"), F.coalesce("w.address.officialName", "w.name", F.lit(UNKNOWN_NAME)).alias("name"), F.col("w.address.county.text").alias("county"))


def _entity_of(named: DataFrame, kind: str, place: int, column: str) -> DataFrame:
    """(raw_id, <column>) of the mentions of one kind of record."""
    mine = named.where((F.col("ord.kind") == ORDER.index(kind)) & (F.col("ord.place") == place))
    return mine.select(F.col("ord.record").alias("raw_id"), F.xxhash64("entity_key").alias(column))


def normalize(raw: DataFrame, catalog: DataFrame, units: DataFrame, only: str | None = None) -> Silver:
    """The build over raw (raw_id, endpoint_version, payload), with the code catalog (code) and the unit map (pattern, unit, factor).

    A record without its natural key, or whose payload is no JSON, is quarantined and the cursor passes it; several records of one key replay in the
    order of raw_id. Contracts keep the notice of their first record. Details never set an acquisition's parties; they alone set its
    type. Where a detail tells a party's source id, the first claim of an id wins. Empty archives give empty tables."""
    kinds = [k for k in ORDER if only in (None, k)]
    good, bad = {}, []
    for k in kinds:
        # each payload is parsed once, whatever reads the table of its kind
        why = F.when(F.get_json_object("payload", "$").isNull(), "payload is no JSON").otherwise(F.concat(F.lit("no "), F.lit(silver.KEYS[k])))
        lost = silver.natural_key(k).isNull()
        both = silver.parsed(raw, k).select("raw_id", "endpoint_version", F.when(~lost, F.col("p")).alias("p"), F.when(lost, why).alias("reason"), F.when(lost, F.substring("payload", 1, 2000)).alias("excerpt"))
        both = stored(both, "parsed")
        good[k] = both.where("reason is null").select("raw_id", "endpoint_version", "p")
        bad.append(both.where("reason is not null").select("raw_id", "endpoint_version", "reason", "excerpt"))
    out = Silver(quarantine=_union(bad))
    named = stored(silver.named_mentions(_mentions(good)), "mentions")
    out.tables["organisations"], out.tables["conflicts"] = silver.organisations_of(named)

    for name, k in (("notices", "tender-list:v1"), ("awards", "award-list:v1")):
        if k in good:
            rows = silver.with_catalog(silver.notices_of(good[k], k), catalog).join(_entity_of(named, k, 0, "authority_id"), "raw_id", "left").drop("authority_code", "authority_name")
            out.tables[name] = sinks.latest(rows, ["notice_id"], "raw_id")
    if "award-contracts:v1" in good:
        c = silver.contracts_of(good["award-contracts:v1"])
        cols = ["contract_no", "title", "value", "currency", "contract_date", "lots_caption", "raw_id"]
        turn = F.struct("raw_id", "place")
        best = c.groupBy("contract_id").agg(F.max_by(F.struct(*cols), turn).alias("r"), F.min_by(F.struct("ca_notice_id"), turn).alias("f"))
        out.tables["contracts"] = best.select("contract_id", "f.ca_notice_id", *(F.col("r")[x].alias(x) for x in cols))
        w = winner_mentions(c).join(named.where(F.col("namespace") == "winner").select("ord", F.xxhash64("entity_key").alias("supplier_id")), "ord")
        out.tables["contract_winners"] = w.select("contract_id", "supplier_id").distinct()
    das = [k for k in ("da-list:v1", "da-detail:v1") if k in good]
    if das:
        parts = []
        for k in das:
            rows = silver.with_catalog(silver.acquisitions_of(good[k], k), catalog)
            for place, side in enumerate(("authority", "supplier")):
                rows = rows.drop(side).join(_entity_of(named, k, place, f"{side}_id"), "raw_id", "left") if k == "da-list:v1" else rows.drop(side).withColumn(f"{side}_id", F.lit(None).cast("long"))
            parts.append(rows.withColumn("turn", F.lit(ORDER.index(k))))
        header = ["da_code", "cpv_code", "cpv_valid", "cpv_raw", "estimated", "closing", "publication", "finalization", "state", "raw_id"]
        groups = {"parties": (F.col("kind") == "list", ["authority_id", "supplier_id"]), "detail": (F.col("kind") == "detail", ["acquisition_type"]), "header": (F.lit(True), header)}
        out.tables["acquisitions"] = sinks.latest_by_part(_union(parts), ["da_id"], groups, "turn", "raw_id")
    if "da-detail:v1" in good:
        out.tables["items"] = sinks.latest(silver.items_of(good["da-detail:v1"], units).drop("_key"), ["item_id"], "raw_id")
        if "da-list:v1" in good:
            out.tables["source_ids"] = linked_ids(good["da-detail:v1"], out.tables["acquisitions"])
    counted = raw.where(F.col("endpoint_version").isin(*kinds)).groupBy("endpoint_version").agg(F.count("*").alias("seen"), F.max("raw_id").alias("cursor"))
    lost = out.quarantine.groupBy("endpoint_version").agg(F.count("*").alias("quarantined"))
    done = counted.join(lost, "endpoint_version", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(0)).cast("long"))
    out.report = done.select("endpoint_version", (F.col("seen") - F.col("quarantined")).alias("processed"), "quarantined")
    out.cursors = counted.select("endpoint_version", "cursor")
    return out


def linked_ids(details: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """(namespace, source_id, entity_id): source ids that details tell of parties which lists resolved; the first claim of an id wins."""
    d = details.select("raw_id", F.col("p.directAcquisitionID").alias("da_id"), F.col("p.contractingAuthorityID").alias("authority"), F.col("p.supplierId").alias("supplier"))
    d = d.join(acquisitions.select("da_id", "authority_id", "supplier_id"), "da_id")
    claims = _union([d.select("raw_id", F.lit(s).alias("namespace"), F.col(s).alias("source_id"), F.col(f"{s}_id").alias("entity_id")) for s in ("authority", "supplier")])
    return claims.where("source_id is not null and entity_id is not null").groupBy("namespace", "source_id").agg(F.min_by("entity_id", F.struct("raw_id", "entity_id")).alias("entity_id"))


def pending(raw: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records behind each kind's cursor (endpoint_version, cursor); a kind without one starts at its first record."""
    c = cursors.select(F.col("endpoint_version"), F.col("cursor").alias("_cursor"))
    return raw.join(F.broadcast(c), "endpoint_version", "left").where("_cursor is null or raw_id > _cursor").drop("_cursor")
