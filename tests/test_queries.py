"""Every registered query against its DuckDB equivalent on the smallest tables."""

from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from spendgrid import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(df):
    """Rows with columns by name, in an order that does not depend on how a column's numbers are kept."""

    def cell(x):
        if isinstance(x, (list, tuple, dict)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return repr(list(x.items()) if isinstance(x, dict) else list(x))
        if pd.isna(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)
