"""Organisations resolved batch by batch: what mentions tell is kept by what they are named by, and merged on read, so that any split into batches gives what one run gives.

A mention is named by its source id, else by its valid fiscal code, else by a hash of what was written; what these names hold (the first code, name and county by order, variants, days) can be added up
in any order. The key of an organisation follows from its names: an id goes to the first valid code that it was met with, so a batch may move an id, with all that it holds, from an organisation of
its own, or from a later code, to another one: only the organisations that it leaves and joins change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .merge import MergedTable, Part
from .silver import named_key

#: What is kept of each name.
PARTS = {
    "id": Part(["namespace", "source_id"], ["source_id"]), "owned": Part(["code"], ["ord"], first=True), "label": Part(["name"], ["ord"], first=True), "place": Part(["county"], ["ord"], first=True),
    "begin": Part(["seen_at"], ["seen_at"], first=True), "end": Part(["seen_at"], ["seen_at"]),
}
COLLECTED = {"code_variants": "code_raw", "codes": "valid_code"}


class Resolution:
    """The state of a resolution in a shared folder: append() mentions (ord, namespace, source_id, code_raw, name, county, seen_at), read organisations() and conflicts().

    ord must be of one type, and tells which mention came first, whatever batch it comes in. Null columns tell nothing; repeated mentions and batches change nothing."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.table = MergedTable(spark, folder, ["atom"], PARTS, buckets=buckets, collected=COLLECTED)

    def append(self, mentions: DataFrame, batch: str) -> int:
        m = mentions.withColumn("code", X.fiscal_code(F.col("code_raw")))
        m = m.withColumn("valid", F.coalesce(X.fiscal_code_valid(F.col("code")), F.lit(False)))
        m = m.withColumns({"valid_code": F.when(F.col("valid"), F.col("code")), "atom": named_key(F.lit(None).cast("string"))})
        known = {c: F.col(c).isNotNull() for c in ("source_id", "name", "county", "seen_at")}
        return self.table.append(m, batch, {"id": known["source_id"], "owned": F.col("valid"), "label": known["name"], "place": known["county"], "begin": known["seen_at"], "end": known["seen_at"]})

    def compact(self) -> int:
        return self.table.compact()

    def atoms(self, version: int | None = None) -> DataFrame:
        """The names with the key of their organisation, as of a version (by default the last)."""
        code = F.col("owned")["v"]["code"]
        key = F.when(F.col("id").isNotNull() & code.isNotNull(), F.concat(F.lit("code:"), code)).otherwise(F.col("atom"))
        return self.table.merged(version).withColumn("entity_key", key)

    @staticmethod
    def _grouped(atoms: DataFrame) -> DataFrame:
        first = lambda p: F.min_by(F.col(p)["v"], F.col(p)["o"])
        g = atoms.groupBy("entity_key").agg(
            F.max(F.col("owned")["v"]["code"].isNotNull()).alias("code_valid"), first("label")["name"].alias("name"), first("place")["county"].alias("county"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("code_variants")))).alias("code_variants"), F.array_sort(F.collect_set(F.col("id")["v"]["source_id"])).alias("source_ids"),
            F.min(F.col("begin")["v"]["seen_at"]).alias("first_seen"), F.max(F.col("end")["v"]["seen_at"]).alias("last_seen"),
        )
        code = F.when(F.col("entity_key").startswith("code:"), F.substring("entity_key", 6, 1 << 20))
        return g.withColumns({"code": code, "entity_id": F.xxhash64("entity_key")})

    def organisations(self) -> DataFrame:
        return self._grouped(self.atoms())

    def conflicts(self) -> DataFrame:
        """(namespace, source_id, owned, other): valid codes that an id was met with and does not own."""
        a = self.atoms().where(F.col("id").isNotNull()).select(F.col("id")["v"]["namespace"].alias("namespace"), F.col("id")["v"]["source_id"].alias("source_id"), F.col("owned")["v"]["code"].alias("owned"), F.explode("codes").alias("other"))
        return a.where("other <> owned")

    def touched(self, since: int) -> tuple[DataFrame, DataFrame]:
        """(organisations that changed since a version, keys of those that are no more): only names of the batches since then and the organisations that these leave and join are grouped anew."""
        now = self.atoms()
        names = self.table.changes(since).select("atom").distinct()
        joined = now.join(names, "atom", "left_semi").select("entity_key")
        left = (self.atoms(since).join(names, "atom", "left_semi").select("entity_key") if since else joined).unionByName(joined).distinct()
        mine = now.join(left, "entity_key", "left_semi")
        return self._grouped(mine), left.join(now.select("entity_key").distinct(), "entity_key", "left_anti")
