"""Every registered plan against its DuckDB oracle (row count, columns, rows) at sf0.001."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shelfwise.plans.oracle_sql import oracle_queries
from shelfwise.plans.registry import plans

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


KEYS = sorted(oracle_queries())


@pytest.mark.parametrize("key", KEYS)
def test_plan_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[key])
    ocols = [x[0] for x in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(got, df.columns) == _canon(want, ocols)


# Result columns that an ordered report is sorted by, with the direction.
ORDERED = {
    "recent_receipts": [("receipt_date", True), ("product_name", False)],
    "region_customer_receipts": [("full_name", False), ("product_name", False)],
    "top_customer_spending": [("total_spent", True)],
    "shipments_by_credit": [("credit_rating", False)],
    "receipts_vs_shipments": [("product_name", False)],
    "full_sales_summary": [("total_revenue", True)],
}


@pytest.mark.parametrize("key", sorted(ORDERED))
def test_ordered_reports_come_in_order(spark, key):
    got = queries()[key](spark, SF).collect()
    want = list(got)
    for column, descending in reversed(ORDERED[key]):
        want.sort(key=lambda r: r[column], reverse=descending)
    columns = [c for c, _ in ORDERED[key]]
    assert [[r[c] for c in columns] for r in got] == [[r[c] for c in columns] for r in want]


def test_every_plan_has_an_oracle_and_entry_smoke(spark):
    assert set(plans()) == set(oracle_queries())
    assert set(plans()) <= set(queries()) and set(oracle_queries()) <= set(oracle_sql())
    out = entry(spark)
    assert out.columns == ["full_name", "product_name", "total_quantity_sold", "total_revenue"]
    assert out.count() > 0
