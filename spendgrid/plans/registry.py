"""The registered queries: each runs an operator over the driver's tables and, where SQL can say it, names its equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flags import Limits
from ..sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Thresholds that make every rule fire on the driver's tables at every size.
LIMITS = Limits(
    max_plausible=100_000, goods=80_000, works=95_000, rapid_hours=720, round_floor=0.9, split_count=2, top_supplier=0.10, min_suppliers=3,
    min_total=100_000, top_authority=0.008, min_supplier_total=50_000, december=0.35, min_year_total=100_000, works_division="PROMO",
)

# The logical views as SQL, for the equivalents.
DA = """(SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, l_quantity AS quantity, o_custkey AS authority_id,
 l_suppkey AS supplier_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS closing, o_orderdate AS publication, l_shipdate AS finalization,
 p_type AS division, l_returnflag AS acquisition_type,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(l_extendedprice AS DECIMAL(18,2)), strftime(l_shipdate, '%Y-%m-%d')) AS da_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
WINNERS = "(SELECT DISTINCT l_orderkey AS contract_id, l_suppkey AS supplier_id FROM lineitem)"
PAIRS = f"""(SELECT authority_id, supplier_id, 'da' AS src, CAST(NULL AS BIGINT) AS contract_id, CAST(closing AS DOUBLE) AS full_, CAST(closing AS DOUBLE) AS split, finalization AS activity FROM {DA}
 UNION ALL SELECT o_custkey, w.supplier_id, 'contract', o_orderkey, o_totalprice, o_totalprice / w.n, o_orderdate
 FROM orders JOIN (SELECT contract_id, supplier_id, count(*) OVER (PARTITION BY contract_id) AS n FROM {WINNERS}) w ON o_orderkey = w.contract_id)"""
ORGS = """(SELECT c_custkey AS entity_id, 'authority' AS role, c_name AS name, n_name AS county FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT s_suppkey, 'supplier', s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def half_up_sql(x: str, places: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,12)), {places}) AS DOUBLE)"


def da_id():
    """A key of an acquisition: its columns joined, as its line number is not unique."""
    return F.concat_ws("-", "order_id", "line", "part_id", "supplier_id", F.col("quantity").cast("int"), "closing", F.date_format("finalization", "yyyy-MM-dd"))


def query(name: str, sql: str | None = None):
    """Register a function of Views under a name, with its SQL equivalent."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register
