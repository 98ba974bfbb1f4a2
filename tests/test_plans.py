"""Plan shape: pushdown, pruning, no cartesian products, no row-level Python, anti joins."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest

from shelfwise.plans.registry import OPERATORS, run
from shelfwise.sources.landing import land_star
from shelfwise.sources.tpch_fixture import star_from_tpch

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landed"))
    return land_star(spark, star_from_tpch(spark, SF), os.path.join(base, "star"))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_cartesian_or_nested_loop(landed, name):
    text = plan_text(run(name, landed))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


# Python may only touch aggregated rows: the t-distribution plans.
PYTHON_OK = {"receipt_sales_ttest", "receipt_sales_ttest_ci", "high_volume_reg",
             "high_volume_reg_coefficients", "statistical_summary", "statistical_summary_batches"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_python_except_t_distribution(landed, name):
    text = plan_text(run(name, landed))
    if name not in PYTHON_OK:
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    assert "BatchEvalPython" not in text  # never row-at-a-time Python


def test_date_filter_pushed_to_parquet(landed):
    text = plan_text(run("recent_receipts", landed))
    assert "PushedFilters: [IsNotNull(date), GreaterThan(date,2001-06-01)" in text


def test_column_pruning_reaches_scan(landed):
    text = plan_text(run("top_customer_spending", landed))
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema:")]
    assert "ReadSchema: struct<unit_price:double,quantity:int,customer_id:bigint>" in scans
    assert not any("address" in s or "credit_rating" in s for s in scans)


def test_anti_joins_probe_distinct_keys(landed):
    text = plan_text(run("unshipped_sales", landed))
    assert "LeftAnti" in text
    assert "HashAggregate" in text  # the distinct of shipped sales ids, before the probe


def test_top_k_is_take_ordered(landed):
    assert "TakeOrderedAndProject" in plan_text(run("top_customer_spending", landed))


def test_fact_join_preaggregated(landed):
    # Shipments are collapsed per sale before meeting the invoices.
    text = plan_text(run("full_sales_summary", landed))
    assert "partial_count(1)" in text and "partial_sum(quantity_sold" in text


@pytest.fixture()
def no_broadcast(spark):
    """Imitates data-sized dimensions: nothing fits a broadcast, and the plan is the one that runs."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    saved = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


def counts(df, *nodes) -> dict[str, int]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return {n: len(re.findall(rf"\b{n}\b", buf.getvalue())) for n in nodes}


FOLDED = ["customer_purchase_stats", "customer_spending_reg", "customer_sales_growth", "inventory_turnover_stats"]


@pytest.mark.parametrize("name", FOLDED)
def test_moments_per_name_read_their_fact_once(landed, no_broadcast, name):
    got = counts(run(name, landed), "FileScan", "Exchange", "SortMergeJoin")
    assert got["FileScan"] == 2  # the fact and the dimension
    assert got["Exchange"] <= 4 and got["SortMergeJoin"] == 1


def test_quartiles_read_the_joined_lines_once(landed, no_broadcast):
    got = counts(run("credit_rating_summaries", landed), "FileScan")
    assert got["FileScan"] == 2  # both passes read the same shuffled lines


def test_bucketed_landing_removes_fact_shuffles(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("bucketed"))
    src = star_from_tpch(spark, SF)
    plain = land_star(spark, src, os.path.join(base, "plain"))
    buck = land_star(spark, src, os.path.join(base, "buck"), buckets=4)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k) for k in keys}
    for k in keys:  # imitate data-sized dimensions: nothing fits a broadcast
        spark.conf.set(k, "-1")
    try:
        for name in ("unshipped_sales", "validate_qty_match", "shipment_delays", "full_sales_summary"):
            before = plan_text(run(name, plain)).split("\n\n")[0].count("Exchange")
            after = plan_text(run(name, buck)).split("\n\n")[0].count("Exchange")
            assert after < before, name
            assert sorted(run(name, buck).collect()) == sorted(run(name, plain).collect())
        assert plan_text(run("unshipped_sales", buck)).split("\n\n")[0].count("Exchange") == 0
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
