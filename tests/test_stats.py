"""Statistics edge cases (one observation, constant regressors, zero divisors) and t tables."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest
from conftest import d, make_star, rows
from pyspark.sql import functions as F

from shelfwise.functions import regression as ols
from shelfwise.functions.distributions import t_critical, t_two_sided_p
from shelfwise.operators import stats as S

C = [(1, "Sam", "Lee", "x, NY", "Good"), (2, "Ann", "Bo", "y, CA", "Poor")]
P = [(10, "widget", 100, 2.0, 5.0), (11, "gizmo", 0, 1.0, 3.0)]


def test_one_sale_customer_sd_null_and_no_regression(spark):
    sales = [(1, 2.0, 3, d("2024-01-01"), 10, 1), (2, 2.0, 4, d("2024-01-02"), 10, 2),
             (3, 3.0, 6, d("2024-01-05"), 10, 2)]
    star = make_star(spark, C, P, sales)
    out = {r["full_name"]: r for r in S.customer_purchase_stats(star).collect()}
    assert out["Sam Lee"]["total_purchases"] == 1 and out["Sam Lee"]["std_dev_quantity"] is None
    assert out["Ann Bo"]["average_quantity"] == 5.0
    assert out["Ann Bo"]["std_dev_quantity"] == pytest.approx(math.sqrt(2))
    fits = rows(S.customer_spending_reg(star))
    assert [f[0] for f in fits] == ["Ann Bo"]
    # spending 8 at q=4, 18 at q=6 -> slope 5, intercept -12
    assert fits[0][1] == pytest.approx(-12.0) and fits[0][2] == pytest.approx(5.0)
    growth = rows(S.customer_sales_growth(star))
    assert growth == [("Ann Bo", pytest.approx((18 - 8) / 3))]


def test_constant_x_slope_null_intercept_mean(spark):
    sales = [(1, 1.0, 2, d("2024-01-01"), 10, 1), (2, 2.0, 2, d("2024-01-02"), 10, 1),
             (3, 6.0, 2, d("2024-01-03"), 10, 1)]
    star = make_star(spark, C, P, sales)
    (name, intercept, slope), = rows(S.customer_spending_reg(star))
    assert slope is None and intercept == pytest.approx((2 + 4 + 12) / 3)


def test_all_sales_one_day_growth_null_and_excluded_from_share(spark):
    from shelfwise.operators.summary import statistical_summary

    sales = [(1, 1.0, 2, d("2024-01-01"), 10, 1), (2, 2.0, 2, d("2024-01-01"), 10, 1),
             (3, 1.0, 1, d("2024-01-01"), 10, 2), (4, 3.0, 1, d("2024-01-03"), 10, 2)]
    star = make_star(spark, C, P, sales)
    assert rows(S.customer_sales_growth(star)) == [("Ann Bo", 1.0), ("Sam Lee", None)]
    summ = {r["metric"]: r["value"] for r in statistical_summary(star).collect()}
    assert summ["pct_positive_growth"] == 100.0


def test_zero_inventory_and_zero_revenue_are_null(spark):
    sales = [(1, 0.0, 2, d("2024-01-01"), 11, 1)]
    shipments = [(1, 1, d("2024-01-02"), 2, 11), (2, 1, d("2024-01-02"), 4, 10)]
    star = make_star(spark, C, P, sales, shipments)
    turn = {r["product_name"]: r for r in S.inventory_turnover_stats(star).collect()}
    assert turn["gizmo"]["avg_turnover_rate"] is None
    assert turn["widget"]["avg_turnover_rate"] == pytest.approx(0.04)
    (name, rev, cost, margin), = rows(S.product_profit_margins(star))
    assert (name, rev, cost, margin) == ("gizmo", 0.0, 2.0, None)


def test_empty_facts(spark):
    star = make_star(spark, C, P)
    r = S.shipment_delay_stats(star).first()
    assert (r["total_delays"], r["average_delay_days"]) == (0, None)
    assert rows(S.receipt_sales_diff(star)) == [("gizmo", 0, 0), ("widget", 0, 0)]


def test_constant_received_correlation_null(spark):
    receipts = [(1, 10, d("2024-01-01"), 5), (2, 11, d("2024-01-01"), 5)]
    shipments = [(1, 1, d("2024-01-01"), 3, 10), (2, 2, d("2024-01-01"), 9, 11)]
    star = make_star(spark, C, P, shipments=shipments, receipts=receipts)
    r = S.quantity_stats(star).first()
    assert r["correlation_received_sold"] is None
    assert r["mean_received"] == 5.0 and r["mean_sold"] == 6.0


def test_quartiles_interpolate_linearly(spark):
    sales = [(i, v, 1, d("2024-01-01"), 10, 1) for i, v in enumerate([1.0, 2.0, 4.0, 10.0])]
    star = make_star(spark, C, P, sales)
    (rating, mean, median, q1, q3), = rows(S.credit_rating_summaries(star))
    assert (rating, mean, median, q1, q3) == ("Good", 4.25, 3.0, 1.75, 5.5)
    approx = S.credit_rating_summaries(star, quantiles="approx").first()
    assert approx["median_revenue"] in (2.0, 4.0)


def test_paired_t_test(spark):
    # receipts - sales per product: d = 1, 2, 3, 4, 5
    products = [(i, f"p{i}", 10, 1.0, 2.0) for i in range(5)]
    receipts = [(i, i, d("2024-01-01"), 10 + i + 1) for i in range(5)]
    sales = [(i, 1.0, 10, d("2024-01-01"), i, 1) for i in range(5)]
    star = make_star(spark, C, products, sales, receipts=receipts)
    r = S.receipt_sales_ttest(star).first()
    assert r["n"] == 5 and r["df"] == 4
    assert r["mean_diff"] == pytest.approx(3.0)
    assert r["std_dev_diff"] == pytest.approx(1.581139, abs=1e-6)
    assert r["t_statistic"] == pytest.approx(4.242641, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.013236, abs=1e-6)
    ci = S.receipt_sales_ttest_ci(star).first()
    half = 2.776445 * 1.581139 / math.sqrt(5)
    assert ci["conf_low"] == pytest.approx(3 - half, abs=1e-5)
    assert ci["conf_high"] == pytest.approx(3 + half, abs=1e-5)


def test_t_table_values():
    # Published two-sided 5 % critical values and tail probabilities.
    assert t_critical(np.array([0.95]), np.array([99.0]))[0] == pytest.approx(1.984217, abs=1e-6)
    assert t_critical(np.array([0.95]), np.array([1.0]))[0] == pytest.approx(12.706205, abs=1e-5)
    assert t_critical(np.array([0.99]), np.array([10.0]))[0] == pytest.approx(3.169273, abs=1e-6)
    p = t_two_sided_p(np.array([1.0, 2.0, 6.13]), np.array([1.0, 30.0, 99.0]))
    assert p[0] == pytest.approx(0.5, abs=1e-12)  # Cauchy: P(|T|>1) = 1/2
    assert p[1] == pytest.approx(0.054625, abs=1e-6)  # 2 * pt(-2, 30)
    assert p[2] < 1e-7
    big_df = t_two_sided_p(np.array([1.959964]), np.array([1e7]))[0]
    assert big_df == pytest.approx(0.05, abs=1e-5)


def test_high_volume_regression_closed_form(spark):
    products = [(i, f"p{i}", 10, 1.0, 2.0) for i in range(6)]
    x = [600, 700, 800, 900, 1000, 1100]
    y = [5, 9, 8, 14, 15, 20]
    receipts = [(i, i, d("2024-01-01"), x[i]) for i in range(6)]
    shipments = [(i, i, d("2024-01-01"), y[i], i) for i in range(6)]
    star = make_star(spark, C, products, shipments=shipments, receipts=receipts)
    fit = S.high_volume_reg(star).first()
    b, a = np.polyfit(x, y, 1)
    resid = np.array(y) - (a + b * np.array(x))
    sse = float(resid @ resid)
    sigma = math.sqrt(sse / 4)
    r2 = 1 - sse / float(((np.array(y) - np.mean(y)) ** 2).sum())
    assert fit["slope"] == pytest.approx(b) and fit["intercept"] == pytest.approx(a)
    assert fit["r_squared"] == pytest.approx(r2)
    assert fit["residual_std_error"] == pytest.approx(sigma)
    assert fit["df_residual"] == 4
    coefs = {r["term"]: r for r in S.high_volume_reg_coefficients(star).collect()}
    sxx = float(((np.array(x) - np.mean(x)) ** 2).sum())
    assert coefs["total_received"]["std_error"] == pytest.approx(sigma / math.sqrt(sxx))
    t = b / (sigma / math.sqrt(sxx))
    assert coefs["total_received"]["p_value"] == pytest.approx(float(t_two_sided_p(t, 4.0)))
    assert fit["f_p_value"] == pytest.approx(coefs["total_received"]["p_value"])
    res = S.high_volume_reg_residuals(star).first()
    assert res["residual_min"] == pytest.approx(resid.min())
    assert res["residual_median"] == pytest.approx(np.percentile(resid, 50))
    assert res["residual_max"] == pytest.approx(resid.max())


def test_customer_id_grain_keeps_namesakes_apart(spark):
    from shelfwise.operators.summary import statistical_summary

    customers = [(1, "Sam", "Lee", "x", "Good"), (2, "Sam", "Lee", "y", "Good")]
    sales = [(1, 2.0, 1, d("2024-01-01"), 10, 1), (2, 2.0, 3, d("2024-01-02"), 10, 1),
             (3, 1.0, 5, d("2024-01-01"), 10, 2), (4, 1.0, 9, d("2024-01-04"), 10, 2)]
    star = make_star(spark, customers, P, sales)
    by_id = {r["customer_id"]: r for r in S.customer_purchase_stats(star, customer_key="customer_id").collect()}
    assert by_id[1]["average_quantity"] == 2.0 and by_id[2]["average_quantity"] == 7.0
    fits = {r["customer_id"]: r for r in S.customer_spending_reg(star, customer_key="customer_id").collect()}
    assert fits[1]["slope"] == pytest.approx(2.0) and fits[2]["slope"] == pytest.approx(1.0)
    by_name = rows(S.customer_purchase_stats(star), "full_name", "total_purchases")
    assert by_name == [("Sam Lee", 4)]
    summ = {r["metric"]: r["value"] for r in statistical_summary(star, customer_key="customer_id").collect()}
    assert summ["mean_purchases_per_customer"] == 2.0 and summ["median_slope"] == 1.5


@pytest.mark.parametrize("n", [3000, 20000])
@pytest.mark.parametrize("ids", [1, 2])
def test_slope_of_a_hot_customer_with_one_other_day(spark, n, ids):
    # n invoices of 10 on one day, one of 100 on the next: the slope is exactly 90.
    from pyspark.sql import functions as F

    customers = [(i + 1, "Sam", "Lee", "x, NY", "Good") for i in range(ids)]
    star = make_star(spark, customers, P, [(0, 100.0, 1, d("2024-01-02"), 10, ids)])
    many = spark.range(1, n + 1).select(
        F.col("id").alias("sales_id"), F.lit(10.0).alias("unit_price"), F.lit(1).alias("quantity"),
        F.lit(d("2024-01-01")).alias("date"), F.lit(10).cast("long").alias("product_id"),
        F.lit(1).cast("long").alias("customer_id"),
    )
    star = dataclasses.replace(star, sales=star.sales.unionByName(many))
    (name, rate), = rows(S.customer_sales_growth(star))
    assert rate == pytest.approx(90.0, abs=1e-9)
    (name, intercept, slope), = rows(S.customer_spending_reg(star))  # quantity never varies
    assert slope is None and intercept == pytest.approx((10 * n + 100) / (n + 1))


def test_summary_keeps_metrics_without_values(spark):
    from shelfwise.operators.summary import statistical_summary

    sales = [(1, 2.0, 3, d("2024-01-01"), 10, 1), (2, 4.0, 3, d("2024-01-01"), 10, 1)]
    star = make_star(spark, [C[0]], [P[0]], sales)
    out = {(r["analysis"], r["metric"]): r["value"] for r in statistical_summary(star).collect()}
    assert len(out) == 22  # 21 fixed metrics and one rating
    assert out["CustomerSpendingReg", "median_slope"] is None
    assert out["CustomerSalesGrowth", "median_growth_rate"] is None
    assert out["InventoryTurnoverStats", "mean_turnover_rate"] is None
    assert out["CustomerPurchaseStats", "mean_avg_quantity"] == 3.0


@pytest.mark.parametrize("salts", [1, 3, 4096])
def test_folded_moments_match_those_of_all_rows(spark, salts):
    rng = np.random.default_rng(salts)
    raw = [
        (name, int(key), float(1e9 + 1e-3 * rng.normal()) if name == "far" else 5.0 if name == "flat" else float(rng.normal()),
         None if rng.random() < 0.1 else float(rng.normal(3)))
        for name, keys in (("far", 40), ("flat", 7), ("many", 300), (None, 2))
        for key in range(keys) for _ in range(int(rng.integers(1, 9)))
    ] + [("none", 1, 1.0, None)]
    frame = spark.createDataFrame(raw, "name string, key int, x double, y double").repartition(5)
    parts = frame.groupBy("name", "key").agg(F.count(F.lit(1)).alias("rows"), *ols.centred_moments(F.col("y"), F.col("x"), "_p"))
    got = {r["name"]: r for r in ols.fold_moments(parts, ["name"], "key", ("_p",), ("rows",), salts).collect()}
    for name in ("far", "flat", "many", None):
        x, y = np.array([(x, y) for n, _, x, y in raw if n == name and y is not None]).T
        r = got[name]
        assert r["rows"] == sum(n == name for n, *_ in raw) and r["_p_n"] == len(x)
        assert r["_p_ax"] == pytest.approx(x.mean()) and r["_p_ay"] == pytest.approx(y.mean())
        assert r["_p_syy"] == pytest.approx(((y - y.mean()) ** 2).sum())
        dx = x - x[0]  # of values near 1e9 only differences keep their digits
        assert r["_p_sxx"] == pytest.approx(((dx - dx.mean()) ** 2).sum(), rel=1e-3)
        assert r["_p_sxy"] == pytest.approx(((dx - dx.mean()) * (y - y.mean())).sum(), rel=1e-3, abs=1e-9)
    assert got["flat"]["_p_sxx"] == 0.0 and got["flat"]["_p_sxy"] == 0.0
    assert got["none"]["_p_n"] == 0 and got["none"]["_p_ax"] is None and got["none"]["_p_sxx"] is None


def test_totals_combine_after_the_keys_are_brought_together(spark):
    """Wide rows of moments are made per key, not per key and task of the scan; a key's rows split among
    tasks are one row in the end."""
    import contextlib
    import io

    from shelfwise.operators.facts import sales_by_customer, sales_by_product, sales_totals

    sales = [(i, 1.0 + i % 7, i % 5, d("2024-01-01"), None if i % 50 == 0 else i % 9, 0 if i % 3 else i % 40) for i in range(600)]
    star = make_star(spark, sales=sales)
    totals = sales_totals(star)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        totals.explain(mode="simple")
    lines = out.getvalue().splitlines()
    first = next(i for i, line in enumerate(lines) if "partial_regr" in line or "partial_count" in line)
    assert any("REBALANCE_PARTITIONS_BY_COL" in line for line in lines[first:])
    with_totals = star.with_aggregates(sales_totals=totals)
    for by in (sales_by_customer, sales_by_product):
        got, want = ({r[0]: r for r in by(s).collect()} for s in (with_totals, star))
        assert got.keys() == want.keys() and by(with_totals).columns == by(star).columns
        for key, row in want.items():
            assert list(got[key]) == [pytest.approx(x, rel=1e-12) if isinstance(x, float) else x for x in row]


def test_invoice_join_takes_equal_shares_of_large_tables():
    from shelfwise.sources.tpch_fixture import MOST_PARTITIONS, line_partitions

    assert line_partitions(10 << 20, 200) is None
    assert line_partitions(1 << 30, 200) == 200 and line_partitions(8 << 30, 200) == 512
    assert line_partitions(1 << 50, 200) == MOST_PARTITIONS and line_partitions(1 << 50, 30_000) == 30_000
