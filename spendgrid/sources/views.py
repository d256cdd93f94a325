"""Logical procurement views over the driver's star-schema tables.

Direct acquisitions are line items, contracts are orders with the suppliers of their lines as winners, notices are events,
organisations are customers (authorities) and suppliers. Driver timestamps carry no zone; they are read as UTC instants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without a zone become instants under the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def acquisitions(self) -> DataFrame:
        """authority_id, supplier_id, closing, publication, finalization, division, acquisition_type; line key columns."""
        lines, orders, parts = self.table("lineitem"), self.table("orders"), self.table("part")
        joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
        return joined.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("o_custkey").alias("authority_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").cast(MONEY).alias("closing"),
            F.col("o_orderdate").alias("publication"),
            F.col("l_shipdate").alias("finalization"),
            F.col("p_type").alias("division"),
            F.col("l_returnflag").alias("acquisition_type"),
        )

    @property
    def facts(self) -> DataFrame:
        """acquisitions without publication and division: what needs no join to parts."""
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("authority_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_extendedprice").cast(MONEY).alias("closing"), F.col("l_shipdate").alias("finalization"), F.col("l_returnflag").alias("acquisition_type")
        )

    @property
    def contracts(self) -> DataFrame:
        """contract_id, authority_id, value, state_date, acquisition_type."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("authority_id"), F.col("o_totalprice").cast(MONEY).alias("value"), F.col("o_orderdate").alias("state_date"), F.col("o_orderpriority").alias("acquisition_type")
        )

    @property
    def winners(self) -> DataFrame:
        """contract_id, supplier_id: each contract's consortium."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_suppkey").alias("supplier_id")).distinct()

    @property
    def notices(self) -> DataFrame:
        """notice_id, kind, state_date, value, evidence (JSON)."""
        return self.table("events").select(F.col("event_id").alias("notice_id"), F.col("event_type").alias("kind"), F.col("ts").alias("state_date"), F.col("value").cast(MONEY).alias("value"), F.col("props").alias("evidence"), F.col("user_id"))

    @property
    def organisations(self) -> DataFrame:
        """entity_id, role, name, county of authorities and suppliers."""
        nations = self.table("nation")
        authorities = self.table("customer").select(F.col("c_custkey").alias("entity_id"), F.lit("authority").alias("role"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("supplier").alias("role"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
        both = authorities.unionByName(suppliers)
        return both.join(nations, both.n == nations.n_nationkey, "left").select("entity_id", "role", "name", F.col("n_name").alias("county"))
