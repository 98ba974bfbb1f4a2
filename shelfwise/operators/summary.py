"""Consolidated metric table: (analysis, metric, value) across the ten analyses.

Each metric is a second-level aggregate over an analysis result (for example the mean of the
per-customer means, not the mean over invoices), computed as a one-row (or per-rating) frame;
the frames are unioned in the reference's step order. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import regression as ols
from shelfwise.functions.columns import pearson
from shelfwise.functions.quantiles import quantiles as quantiles_of
from shelfwise.functions.rounding import round_value
from shelfwise.operators import stats
from shelfwise.functions.distributions import t_pvalue
from shelfwise.operators.facts import (
    customer_grain,
    product_balance,
    received_by_product,
    sales_by_customer,
    sales_by_product,
    sales_totals,
    shipments_by_product,
    shipped_by_product,
)
from shelfwise.session import pinned
from shelfwise.sources.star import Star

# Analysis labels of the consolidated table (fixed values).
CUSTOMER_PURCHASE_STATS = "CustomerPurchaseStats"
PRODUCT_PROFIT_MARGINS = "ProductProfitMargins"
SHIPMENT_DELAY_STATS = "ShipmentDelayStats"
RECEIPT_SALES_DIFF = "ReceiptSalesDiff"
CUSTOMER_SPENDING_REG = "CustomerSpendingReg"
INVENTORY_TURNOVER_STATS = "InventoryTurnoverStats"
CREDIT_RATING_SUMMARIES = "CreditRatingSummaries"
HIGH_VOLUME_REG = "HighVolumeReg"
CUSTOMER_SALES_GROWTH = "CustomerSalesGrowth"
QUANTITY_STATS = "QuantityStats"


def _metric_rows(frame: DataFrame, analysis: str, metrics: list[tuple[str, Column]], order: int) -> DataFrame:
    """Turn one row of ``frame`` into one (analysis, metric, value, _ord) row per metric."""
    return _labelled_rows(frame, [(analysis, name, value, order * 100 + i) for i, (name, value) in enumerate(metrics)])


def _labelled_rows(frame: DataFrame, entries: list[tuple[str, str, Column, int]]) -> DataFrame:
    """One row of ``frame`` -> one (analysis, metric, value, _ord) row per entry."""
    structs = [
        F.struct(
            F.lit(analysis).alias("analysis"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            F.lit(order).alias("_ord"),
        )
        for analysis, metric, value, order in entries
    ]
    return frame.select(F.explode(F.array(*structs)).alias("m")).select("m.*")


def _long(frame: DataFrame, entries: list[tuple[str, str, Column]]) -> DataFrame:
    """Per-group rows of ``frame`` -> (metric, how, value) rows, one per entry."""
    structs = [
        F.struct(F.lit(metric).alias("metric"), F.lit(how).alias("how"), value.cast("double").alias("value"))
        for metric, how, value in entries
    ]
    return frame.select(F.explode(F.array(*structs)).alias("m")).select("m.*")


# (metric, analysis, position) of the second-level metrics, in the reference's order (fixed values).
GROUP_METRICS = [
    ("mean_avg_quantity", CUSTOMER_PURCHASE_STATS, 100),
    ("mean_purchases_per_customer", CUSTOMER_PURCHASE_STATS, 101),
    ("median_margin_pct", PRODUCT_PROFIT_MARGINS, 200),
    ("mean_margin_pct", PRODUCT_PROFIT_MARGINS, 201),
    ("median_slope", CUSTOMER_SPENDING_REG, 600),
    ("median_intercept", CUSTOMER_SPENDING_REG, 601),
    ("mean_turnover_rate", INVENTORY_TURNOVER_STATS, 800),
    ("mean_turnover_variance", INVENTORY_TURNOVER_STATS, 801),
    ("median_growth_rate", CUSTOMER_SALES_GROWTH, 1100),
    ("pct_positive_growth", CUSTOMER_SALES_GROWTH, 1101),
]


def with_totals(star: Star) -> Star:
    """The star with the per-key tables the summary reads several times, each made once."""
    builders = {
        "sales_totals": sales_totals,
        "shipments_by_product": shipments_by_product,
        "received_by_product": received_by_product,
    }
    missing = {name: build for name, build in builders.items() if name not in star.aggregates}
    return star.with_aggregates(**{name: pinned(build(star), name) for name, build in missing.items()})


def _product_metrics(star: Star, min_received: int) -> DataFrame:
    """One row with every product-level metric of the summary, from ONE per-product table and
    ONE aggregation: the paired t-test (received vs invoiced units), the high-volume fit
    (shipped ~ received over products with more than ``min_received`` received, as masked
    co-moments) and the received/shipped correlation with revenue mean and variance."""
    sold = sales_by_product(star).select(
        "product_id", F.col("units").alias("total_sold"), F.col("value").alias("total_revenue")
    )
    totals = product_balance(
        star, received_by_product(star), shipped_by_product(star, "total_shipped"), sold
    )
    received = F.col("total_received").cast("double")
    shipped = F.col("total_shipped").cast("double")
    d = (F.col("total_received") - F.col("total_sold")).cast("double")
    high = F.col("total_received") > min_received
    row = totals.agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("sd"),
        *ols.ols_moments(F.when(high, shipped), F.when(high, received)),
        pearson(shipped, received).alias("c"),
        F.avg("total_revenue").alias("m"),
        F.var_samp("total_revenue").alias("v"),
    )
    t = F.try_divide(F.col("mean_diff"), F.try_divide(F.col("sd"), F.sqrt(F.col("n"))))
    slope_t = F.try_divide(ols.slope(), ols.se_slope())
    return row.select(
        t.alias("t_statistic"),
        t_pvalue(t, F.col("n") - 1).alias("p_value"),
        "mean_diff",
        ols.r_squared().alias("r_squared"),
        ols.slope().alias("slope"),
        t_pvalue(slope_t, ols.residual_df()).alias("p_value_slope"),
        "c",
        "m",
        "v",
    )


def statistical_summary(
    star: Star,
    customer_key: str = "full_name",
    min_received: int = 500,
    min_rows: int = 2,
    digits: int | None = 4,
    quantiles: str = "exact",
) -> DataFrame:
    """(analysis, metric, value) -- 21 fixed metrics plus one ``<rating>_mean_revenue`` per
    credit rating, in step order. ``digits`` rounds the value as it is recorded (4 in the
    reference); ``None`` keeps full precision.

    The facts are read twice at most: invoices once for the per-customer and per-product table
    and once for the delays, shipments likewise. The tables are written to the shared checkpoint
    folder unless the star carries them already.

    Plan shape: the per-group results (customers, product names) are stacked into one long
    (metric, how, value) table, written once; every mean is one grouped average over it and every median
    one pass of the distributed exact quantile -- instead of one pipeline per metric.
    """
    grain = customer_grain(customer_key)
    star = with_totals(star)
    # One projection over one aggregate: every per-customer value comes from the same plan
    # node, so it is computed once however many metrics read it.
    enough = F.col("_rows") >= min_rows
    spend = stats.customer_profile(star, customer_key).select(
        *grain, "_rows", "average_quantity", *ols.unprefixed("_s"),
        *[F.col("_g" + m) for m in ols.MOMENTS],
    )
    per_customer = spend.select(
        *grain,
        F.col("_rows").alias("total_purchases"),
        "average_quantity",
        F.when(enough, ols.slope()).alias("slope"),
        F.when(enough, ols.intercept()).alias("intercept"),
        enough.alias("_enough"),
        *ols.unprefixed("_g"),
    ).select(
        "total_purchases", "average_quantity", "slope", "intercept",
        F.when(F.col("_enough"), ols.slope()).alias("growth_rate"),
    )
    positive = F.when(F.col("growth_rate").isNotNull(), (F.col("growth_rate") > 0).cast("double") * 100)
    margins = stats.product_profit_margins(star)
    turnover = stats.inventory_turnover_stats(star)
    long = (
        _long(
            per_customer,
            [
                ("mean_avg_quantity", "mean", F.col("average_quantity")),
                ("mean_purchases_per_customer", "mean", F.col("total_purchases")),
                ("median_slope", "median", F.col("slope")),
                ("median_intercept", "median", F.col("intercept")),
                ("median_growth_rate", "median", F.col("growth_rate")),
                ("pct_positive_growth", "mean", positive),
            ],
        )
        .unionByName(
            _long(
                margins,
                [
                    ("median_margin_pct", "median", F.col("profit_margin_pct")),
                    ("mean_margin_pct", "mean", F.col("profit_margin_pct")),
                ],
            )
        )
        .unionByName(
            _long(
                turnover,
                [
                    ("mean_turnover_rate", "mean", F.col("avg_turnover_rate")),
                    ("mean_turnover_variance", "mean", F.col("turnover_variance")),
                ],
            )
        )
    )
    long = pinned(long, "summary-metrics")  # read by the means and twice by the medians
    means = long.filter(F.col("how") == "mean").groupBy("metric").agg(F.avg("value").alias("value"))
    medians = quantiles_of(
        long.filter(F.col("how") == "median"), "value", [0.5], by=["metric"], names=["value"], method=quantiles
    )
    group_metrics = means.unionByName(medians.select("metric", "value"))
    # A mean or median over no values still has its row (NULL): the metrics are a fixed list.
    fixed = star.sales.sparkSession.createDataFrame(
        [(analysis, metric, order) for metric, analysis, order in GROUP_METRICS],
        "analysis string, metric string, _ord int",
    )
    group_rows = fixed.join(group_metrics, "metric", "left").select("analysis", "metric", "value", "_ord")

    delay = stats.shipment_delay_stats(star)
    product_row = _product_metrics(star, min_received)
    # Line values per customer id: their count and mean are part of the fit's moments.
    per_customer_value = sales_by_customer(star).select("customer_id", "value", F.col("_s_n").alias("k"))
    credit = (
        per_customer_value.join(star.customers.select("customer_id", "credit_rating"), "customer_id")
        .groupBy("credit_rating")
        .agg(F.try_divide(F.sum("value"), F.sum("k")).alias("mean_revenue"))
    )
    parts = [
        group_rows,
        _metric_rows(
            delay,
            SHIPMENT_DELAY_STATS,
            [("total_delayed_shipments", F.col("total_delays")), ("average_delay_days", F.col("average_delay_days"))],
            4,
        ),
        _labelled_rows(
            product_row,
            [
                (RECEIPT_SALES_DIFF, "t_statistic", F.col("t_statistic"), 500),
                (RECEIPT_SALES_DIFF, "p_value", F.col("p_value"), 501),
                (RECEIPT_SALES_DIFF, "mean_diff", F.col("mean_diff"), 502),
                (HIGH_VOLUME_REG, "r_squared", F.col("r_squared"), 1000),
                (HIGH_VOLUME_REG, "slope_total_received", F.col("slope"), 1001),
                (HIGH_VOLUME_REG, "p_value_slope", F.col("p_value_slope"), 1002),
                (QUANTITY_STATS, "correlation_received_sold", F.col("c"), 1300),
                (QUANTITY_STATS, "mean_revenue", F.col("m"), 1301),
                (QUANTITY_STATS, "revenue_variance", F.col("v"), 1302),
            ],
        ),
        credit.select(
            F.lit(CREDIT_RATING_SUMMARIES).alias("analysis"),
            F.concat(F.col("credit_rating"), F.lit("_mean_revenue")).alias("metric"),
            F.col("mean_revenue").cast("double").alias("value"),
            F.lit(900).alias("_ord"),
            F.col("credit_rating").alias("_sub"),
        ),
    ]
    out = None
    for part in parts:
        if "_sub" not in part.columns:
            part = part.withColumn("_sub", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    value = F.col("value") if digits is None else round_value(F.col("value"), digits)
    return out.orderBy("_ord", "_sub").select("analysis", "metric", value.alias("value"))
