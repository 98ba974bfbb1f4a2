"""Cross-operator invariants on the sf0.01 fixture."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import reports as R
from shelfwise.operators import stats as S
from shelfwise.operators import validation as V
from shelfwise.sources.tpch_fixture import star_from_tpch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def star(spark):
    return star_from_tpch(spark, SF)


def test_received_totals_add_up(star):
    total = star.receipts.agg(F.sum("quantity_received")).first()[0]
    rvs = R.receipts_vs_shipments(star).agg(F.sum("total_received")).first()[0]
    assert rvs == total  # every receipt's product exists in this fixture


def test_unshipped_plus_shipped_is_all_sales(star):
    unshipped = V.validate_unshipped(star).first()[0]
    shipped = star.sales.join(star.shipments.select("sales_id").distinct(), "sales_id", "left_semi").count()
    assert unshipped + shipped == star.sales.count()


def test_matched_plus_mismatched_is_joined_rows(star):
    r = V.validate_qty_match(star).first()
    joined = star.shipments.join(star.sales, "sales_id").count()
    assert r["matched_rows"] + r["mismatched_rows"] == joined  # no NULL quantities here
    assert R.matched_sales_shipments(star).count() == r["matched_rows"]


def test_delays_agree_across_operators(star):
    n_report = R.shipment_delays(star).count()
    r = S.shipment_delay_stats(star).first()
    assert r["total_delays"] == n_report == V.validate_delayed(star).first()[0]
    mean = R.shipment_delays(star).agg(F.avg("delay_days")).first()[0]
    assert r["average_delay_days"] == pytest.approx(mean)


def test_fixture_figures(star):
    # FIXTURES.md measured these on sf0.01.
    assert V.validate_unshipped(star).first()[0] == 19780
    r = V.validate_qty_match(star).first()
    assert (r["matched_rows"], r["mismatched_rows"]) == (23063, 6873)
    assert V.validate_delayed(star).first()[0] == 15377
