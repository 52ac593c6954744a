"""Every query of the core against its SQL in DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

from lodestrata.plans import registry

DIR = "/root/testdata/sf0.001"


def plain(x):
    return float(x) if isinstance(x, Decimal) else round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer", "events", "supplier", "nation"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    rows = order(got.select(*cols).collect())
    assert rows == order(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert rows
