"""The open check registry: expectations, fused scans, and every kind of check."""

from __future__ import annotations

import pytest
from conftest import d, make_star
from pyspark.sql import functions as F
from test_plans import counts, landed, no_broadcast  # noqa: F401 - fixtures

from shelfwise.operators.checks import (
    POSITIVE,
    REPORTED,
    ZERO,
    Check,
    CheckRegistry,
    Expected,
    about,
    frame_check,
    measure,
    run_checks,
    sql_check,
)
from shelfwise.operators.validation import FURTHER_CHECKS, reference_checks, validation_report


@pytest.fixture(scope="module")
def star(spark):
    customers = [(1, "A", "B", "x", "Good"), (2, "C", "D", "y", "Poor")]
    products = [(10, "w", 100, 1.0, 2.0), (11, "v", 5, 9.0, 2.0)]
    sales = [(i, 1.0, i, d("2024-01-01"), 10, 1) for i in range(1, 5)] + [(5, None, 0, None, 99, None)]
    shipments = [(1, 1, d("2024-01-02"), 1, 10), (2, 1, d("2024-01-02"), 1, 10), (3, 7, d("2024-01-02"), 1, 10)]
    return make_star(spark, customers, products, sales, shipments, [(1, 10, d("2023-05-01"), 4)])


def report(df):
    return {(r["check"], r["metric"]): (r["value"], r["expectation"], r["passed"]) for r in df.collect()}


@pytest.mark.parametrize(
    "expected, text, good, bad",
    [
        (ZERO, "0", [0], [1, -1]),
        (POSITIVE, ">0", [1, 0.1], [0, -1]),
        (REPORTED, "reported", [-5, 0], []),
        (Expected(1, 3), ">=1 <=3", [1, 3], [0.9, 3.1]),
        (Expected(high=2), "<=2", [2], [2.5]),
        (about(10, 5, "%"), "~10%", [5, 15], [4.9, 15.1]),
    ],
)
def test_expectations(spark, expected, text, good, bad):
    assert str(expected) == text
    values = spark.createDataFrame([(float(v),) for v in [*good, *bad]] + [(None,)], "v double")
    held = [r[0] for r in values.select(expected.holds(F.col("v"))).collect()]
    assert held == [True] * len(good) + [False] * (len(bad) + 1)


def test_every_kind_of_check(star):
    checks = CheckRegistry()
    checks.add(measure("quantities", "sales_invoices", ZERO, zero="count_if(quantity = 0)", missing=F.count_if(F.col("unit_price").isNull())))
    checks.add(sql_check("late", "SELECT count(*) AS n FROM {shipments} h JOIN {sales_invoices} s ON h.sales_id = s.sales_id WHERE h.date > s.date", POSITIVE))
    checks.add(sql_check("per_rating", "SELECT credit_rating, count(*) AS n, count(DISTINCT last_name) AS names FROM {customers} GROUP BY 1"))
    checks.add(sql_check("none", "SELECT customer_id AS x FROM {customers} WHERE false"))
    checks.add(frame_check("stock", lambda s: s.products.agg(F.sum("inventory_amount").alias("units")), Expected(100, 110)))
    checks.add(measure("largest", "sale_matches", largest="max(n)"))
    checks.add(measure("gone", "receipts", n="count(1)"))
    checks.remove("gone")
    got = report(checks.run(star))
    assert got == {
        ("quantities", "zero"): (1.0, "0", False),
        ("quantities", "missing"): (1.0, "0", False),
        ("late", "n"): (2.0, ">0", True),
        ("per_rating", "Good.n"): (1.0, "reported", True),
        ("per_rating", "Poor.n"): (1.0, "reported", True),
        ("per_rating", "Good.names"): (1.0, "reported", True),
        ("per_rating", "Poor.names"): (1.0, "reported", True),
        ("none", "x"): (None, "reported", False),
        ("stock", "units"): (105.0, ">=100 <=110", True),
        ("largest", "largest"): (2.0, "reported", True),
    }
    assert [r["check"] for r in checks.run(star).collect()][0] == "quantities" and len(checks) == 6


def test_a_callers_check_is_in_the_report(star):
    extra = [sql_check("negative_stock", "SELECT count(*) AS n FROM {products} WHERE inventory_amount < 0", ZERO)]
    with_it, without = report(validation_report(star, extra=extra)), report(validation_report(star))
    assert with_it.pop(("negative_stock", "n")) == (0.0, "0", True)
    assert with_it == without and len(without) == 15
    assert without[("orphans", "sales_missing_customer")] == (1.0, "0", False)
    assert without[("row_counts", "Sales_Invoices")] == (5.0, ">0", True)


def test_wrong_checks_are_refused(star):
    for wrong in ({"on": "sales_invoices"}, {"sql": "SELECT 1", "on": "receipts"}, {}):
        with pytest.raises(ValueError):
            Check("x", **wrong)
    with pytest.raises(ValueError):
        run_checks(star, [measure("x", "no_such_relation", n="count(1)")])


def test_checks_on_a_relation_share_its_scan(landed, no_broadcast):  # noqa: F811
    one = counts(run_checks(landed, [FURTHER_CHECKS[0]]), "FileScan")["FileScan"]
    many = [FURTHER_CHECKS[0], *[measure(f"c{i}", "sales_invoices", n=f"count_if(quantity > {i})") for i in range(8)]]
    assert counts(run_checks(landed, many), "FileScan")["FileScan"] == one == 1
    # Shipments and invoices: the match, the ids, and the two counts.
    assert counts(run_checks(landed, reference_checks(landed)), "FileScan")["FileScan"] <= 8
