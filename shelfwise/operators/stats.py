"""The ten statistical analyses (fourteen result tables), as lazy DataFrame operators.

Where the reference pulls fact rows into R and fits per group, these operators express the
fit as mergeable aggregates (counts, means, co-moments): only a few doubles per group cross
the shuffle, and a group holding a third of all rows is combined map-side like any other.
Quantiles use :func:`shelfwise.functions.quantiles.exact_quantiles`, which never holds one
group in one task. Student-t probabilities are the only Python step and run on aggregated
rows (one per test or fit).

Results are unrounded; rounding is a sink concern (:mod:`shelfwise.functions.rounding`).
Where R returns NA/NaN/Inf (zero divisor, constant regressor, one observation) these return NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import regression as ols
from shelfwise.functions.columns import line_value, pearson
from shelfwise.functions.distributions import t_pvalue, t_quantile
from shelfwise.functions.quantiles import exact_quantiles, quantiles as quantiles_of
from shelfwise.operators.facts import (
    customer_grain,
    customers_named,
    invoiced_by_product,
    late_shipments,
    product_balance,
    products_named,
    received_by_product,
    revenue_by_product,
    sales_by_customer,
    sales_by_product,
    shipments_by_product,
    shipped_by_product,
)
from shelfwise.sources.star import Star


def customer_profile(star: Star, customer_key: str = "full_name") -> DataFrame:
    """One aggregation per customer feeding analyses 1, 5 and 9.

    Invoices are first reduced **per customer id** to centred moments (quantity; line value ~
    quantity; line value ~ invoice day). Only those cross the shuffle into the customer join --
    one row per customer per task instead of every invoice, and a hot customer is combined
    map-side. Per name, the moments of its customers are folded (:func:`ols.fold_moments`); the
    invoices are read once.
    """
    return star.shared(f"customer_profile_{customer_key}", lambda: _customer_profile(star, customer_key))


def _customer_profile(star: Star, customer_key: str) -> DataFrame:
    per_customer = sales_by_customer(star).drop("value")
    grain = customer_grain(customer_key)
    named = customers_named(star).join(per_customer, "customer_id").withColumn("_id", F.col("customer_id"))
    merged = ols.fold_moments(named, grain, "_id", ("_q", "_s", "_g"), sums=("_rows", "units"))
    std_dev = F.sqrt(F.try_divide(F.col("_q_sxx"), F.when(F.col("_q_n") >= 2, F.col("_q_n") - 1)))
    return merged.select(
        *grain,
        "_rows",
        F.try_divide(F.col("units"), F.col("_q_n")).alias("average_quantity"),
        std_dev.alias("std_dev_quantity"),
        *[F.col(prefix + m) for prefix in ("_s", "_g") for m in ols.MOMENTS],
    )


# 1
def customer_purchase_stats(star: Star, customer_key: str = "full_name") -> DataFrame:
    """Per customer: invoice count, mean and sample sd of quantity
    -> (full_name, total_purchases, average_quantity, std_dev_quantity).

    ``total_purchases`` counts invoices even when their quantity is NULL (R's ``n()``).
    """
    return customer_profile(star, customer_key).select(
        *customer_grain(customer_key),
        F.col("_rows").alias("total_purchases"),
        "average_quantity",
        "std_dev_quantity",
    )


# 2
def product_profit_margins(star: Star) -> DataFrame:
    """Per product name: invoice revenue, cost of goods, margin %
    -> (product_name, total_revenue, total_cost, profit_margin_pct).

    Invoices are pre-aggregated per product id (value and units), the unit cost applied after
    the join. Totals over no rows are 0 (R's ``sum(na.rm=TRUE)``); the margin of a zero
    revenue is NULL.
    """
    per_product = sales_by_product(star).select("product_id", "value", "units")
    joined = products_named(star, "cost").join(per_product, "product_id")
    out = joined.groupBy("product_name").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum(F.col("cost") * F.col("units")), F.lit(0.0)).alias("total_cost"),
    )
    margin = F.try_divide(F.col("total_revenue") - F.col("total_cost"), F.col("total_revenue"))
    return out.withColumn("profit_margin_pct", margin * 100)


# 3
def shipment_delay_stats(star: Star) -> DataFrame:
    """One row: number of late shipments and their mean delay in days
    -> (total_delays, average_delay_days)."""
    late = late_shipments(star).select("n", F.datediff("shipment_date", "sales_date").alias("d"))
    return late.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_delays"),
        F.try_divide(F.sum(F.col("n") * F.col("d")), F.sum("n")).alias("average_delay_days"),
    )


# 4a
def receipt_sales_diff(star: Star) -> DataFrame:
    """Per product row: units received vs units invoiced (missing as 0)
    -> (product_name, total_received, total_sold)."""
    return product_balance(star, received_by_product(star), invoiced_by_product(star)).select(
        "product_name", "total_received", "total_sold"
    )


def _paired_moments(star: Star) -> DataFrame:
    diff = receipt_sales_diff(star).select(
        (F.col("total_received") - F.col("total_sold")).cast("double").alias("d")
    )
    m = diff.agg(
        F.count("d").alias("n"),
        F.avg("d").alias("mean_diff"),
        F.stddev_samp("d").alias("std_dev_diff"),
    )
    se = F.try_divide(F.col("std_dev_diff"), F.sqrt(F.col("n")))
    return m.select(
        "n",
        (F.col("n") - 1).alias("df"),
        "mean_diff",
        "std_dev_diff",
        F.try_divide(F.col("mean_diff"), se).alias("t_statistic"),
        se.alias("_se"),
    )


# 4b
def receipt_sales_ttest(star: Star) -> DataFrame:
    """Paired two-sided t-test of received vs invoiced units per product (one row)
    -> (n, df, mean_diff, std_dev_diff, t_statistic, p_value).

    NULL statistics when n < 2 or the differences are constant (R refuses those).
    """
    m = _paired_moments(star)
    return m.select(
        "n", "df", "mean_diff", "std_dev_diff", "t_statistic",
        t_pvalue(F.col("t_statistic"), F.col("df")).alias("p_value"),
    )


# 4b (interval)
def receipt_sales_ttest_ci(star: Star, conf_level: float = 0.95) -> DataFrame:
    """Confidence interval of the mean difference -> (conf_level, conf_low, conf_high)."""
    m = _paired_moments(star)
    half = t_quantile(conf_level, F.col("df")) * F.col("_se")
    return m.select(
        F.lit(conf_level).alias("conf_level"),
        (F.col("mean_diff") - half).alias("conf_low"),
        (F.col("mean_diff") + half).alias("conf_high"),
    )


def spending_fit(profile: DataFrame, grain: list[str], min_rows: int = 2) -> DataFrame:
    """(grain..., intercept, slope) of line value ~ quantity from a :func:`customer_profile`."""
    fits = profile.filter(F.col("_rows") >= min_rows).select(*grain, *ols.unprefixed("_s"))
    return fits.select(*grain, ols.intercept().alias("intercept"), ols.slope().alias("slope"))


def growth_fit(profile: DataFrame, grain: list[str], min_rows: int = 2) -> DataFrame:
    """(grain..., growth_rate): slope of line value ~ invoice day from a :func:`customer_profile`."""
    fits = profile.filter(F.col("_rows") >= min_rows).select(*grain, *ols.unprefixed("_g"))
    return fits.select(*grain, ols.slope().alias("growth_rate"))


# 5
def customer_spending_reg(star: Star, customer_key: str = "full_name", min_rows: int = 2) -> DataFrame:
    """Per customer with at least ``min_rows`` invoices: OLS of line value on quantity
    -> (full_name, intercept, slope). Constant quantity: slope NULL, intercept = mean value."""
    return spending_fit(customer_profile(star, customer_key), customer_grain(customer_key), min_rows)


# 6
def inventory_turnover_stats(star: Star) -> DataFrame:
    """Per product name: mean and sample variance of quantity_sold / inventory_amount per
    shipment -> (product_name, avg_turnover_rate, turnover_variance). Zero inventory -> NULL rate.

    The inventory is constant per product, so shipments are reduced per product id to the count,
    mean and centred sum of squares of the quantity, scaled by the product's inventory, and
    folded per name; the shipments are read once.
    """
    per_product = shipments_by_product(star)
    inv = F.when(F.col("inventory_amount") != 0, F.col("inventory_amount").cast("double"))
    scaled = products_named(star, "inventory_amount").join(per_product, "product_id").select(
        "product_id",
        "product_name",
        F.when(inv.isNotNull(), F.col("_t_n")).otherwise(F.lit(0)).alias("_t_n"),
        *[F.try_divide(F.col("_t" + c), inv).alias("_t" + c) for c in ("_ax", "_ay")],
        # A negative inventory turns the range round.
        F.least(F.col("_t_xlo") / inv, F.col("_t_xhi") / inv).alias("_t_xlo"),
        F.greatest(F.col("_t_xlo") / inv, F.col("_t_xhi") / inv).alias("_t_xhi"),
        *[F.try_divide(F.col("_t" + c), inv * inv).alias("_t" + c) for c in ("_sxx", "_syy", "_sxy")],
    )
    merged = ols.fold_moments(scaled, ["product_name"], "product_id", ("_t",))
    return merged.select(
        "product_name",
        F.col("_t_ax").alias("avg_turnover_rate"),
        F.try_divide(F.col("_t_sxx"), F.when(F.col("_t_n") >= 2, F.col("_t_n") - 1)).alias(
            "turnover_variance"
        ),
    )


# 7
def credit_rating_summaries(star: Star, quantiles: str = "exact", accuracy: int = 100000) -> DataFrame:
    """Per credit rating: mean, median, first and third quartile of invoice line value
    -> (credit_rating, mean_revenue, median_revenue, q1, q3). Quartiles interpolate linearly.

    ``quantiles='exact'`` (default) is distributed and exact; ``'approx'`` uses
    ``percentile_approx`` with ``accuracy`` (one pass, bounded memory, rank error <= n/accuracy).
    """
    lines = star.sales.select("customer_id", line_value().alias("revenue")).join(
        star.customers.select("customer_id", "credit_rating"), "customer_id"
    )
    names, probs = ["median_revenue", "q1", "q3"], [0.5, 0.25, 0.75]
    if quantiles == "exact":
        # A rating without any line value still has its row.
        found = exact_quantiles(
            lines, "revenue", probs, ["credit_rating"], names, mean_name="mean_revenue", keep_empty=True
        )
    elif quantiles == "approx":
        found = (
            lines.groupBy("credit_rating")
            .agg(
                F.avg("revenue").alias("mean_revenue"),
                F.percentile_approx("revenue", probs, accuracy).alias("_q"),
            )
            .select("*", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)])
        )
    else:
        raise ValueError(f"unknown quantiles method {quantiles!r}")
    return found.select("credit_rating", "mean_revenue", "median_revenue", "q1", "q3")


# 8a
def high_volume_reg_data(star: Star, min_received: int = 500) -> DataFrame:
    """Products with more than ``min_received`` units received
    -> (product_name, total_received, total_sold (shipped))."""
    bal = product_balance(star, received_by_product(star), shipped_by_product(star))
    return bal.filter(F.col("total_received") > min_received).select(
        "product_name", "total_received", "total_sold"
    )


def _high_volume_moments(star: Star, min_received: int) -> DataFrame:
    data = high_volume_reg_data(star, min_received)
    return data.agg(*ols.ols_moments(F.col("total_sold").cast("double"), F.col("total_received").cast("double")))


# 8b
def high_volume_reg(star: Star, min_received: int = 500) -> DataFrame:
    """OLS total_sold ~ total_received over :func:`high_volume_reg_data` (one row)
    -> (n, intercept, slope, r_squared, adj_r_squared, residual_std_error, df_residual,
    f_statistic, f_p_value). With one predictor the F p-value is the slope's t p-value."""
    m = _high_volume_moments(star, min_received)
    return m.select(
        *ols.fit_columns(),
        t_pvalue(F.try_divide(ols.slope(), ols.se_slope()), ols.residual_df()).alias("f_p_value"),
    )


# 8c
def high_volume_reg_coefficients(star: Star, min_received: int = 500) -> DataFrame:
    """Coefficient table of :func:`high_volume_reg`, two rows
    -> (term, estimate, std_error, t_value, p_value)."""
    m = _high_volume_moments(star, min_received)
    rows = m.select(
        ols.residual_df().alias("_df"),
        F.explode(
            F.array(
                F.struct(
                    F.lit("(Intercept)").alias("term"),
                    ols.intercept().alias("estimate"),
                    ols.se_intercept().alias("std_error"),
                ),
                F.struct(
                    F.lit("total_received").alias("term"),
                    ols.slope().alias("estimate"),
                    ols.se_slope().alias("std_error"),
                ),
            )
        ).alias("c"),
    ).select("_df", "c.term", "c.estimate", "c.std_error")
    t = F.try_divide(F.col("estimate"), F.col("std_error"))
    return rows.select(
        "term", "estimate", "std_error", t.alias("t_value"), t_pvalue(t, F.col("_df")).alias("p_value")
    )


# 8d
def high_volume_reg_residuals(star: Star, min_received: int = 500, quantiles: str = "exact") -> DataFrame:
    """Five-number summary of the fit's residuals (one row)
    -> (residual_min, residual_q1, residual_median, residual_q3, residual_max).

    The fitted coefficients enter as one scalar subquery (a 1-row aggregate), then every
    product's residual is computed in place; quantiles are exact and distributed.
    """
    data = high_volume_reg_data(star, min_received)
    fit = _high_volume_moments(star, min_received).select(
        F.struct(ols.intercept().alias("a"), F.coalesce(ols.slope(), F.lit(0.0)).alias("b")).alias("fit")
    ).scalar()
    resid = data.select(
        (F.col("total_sold") - (fit.getField("a") + fit.getField("b") * F.col("total_received"))).alias("residual")
    )
    names = ["residual_min", "residual_q1", "residual_median", "residual_q3", "residual_max"]
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    return quantiles_of(resid, "residual", probs, names=names, method=quantiles).drop("n")


# 9
def customer_sales_growth(star: Star, customer_key: str = "full_name", min_rows: int = 2) -> DataFrame:
    """Per customer with at least ``min_rows`` invoices: OLS slope of line value on the invoice
    date in days since 1970-01-01 -> (full_name, growth_rate). All on one day -> NULL."""
    return growth_fit(customer_profile(star, customer_key), customer_grain(customer_key), min_rows)


def quantity_totals(star: Star) -> DataFrame:
    """Per product row: received, shipped and invoiced value, missing as 0."""
    return product_balance(
        star, received_by_product(star), shipped_by_product(star), revenue_by_product(star)
    )


# 10
def quantity_stats(star: Star, quantiles: str = "exact") -> DataFrame:
    """One row over per-product totals -> (correlation_received_sold, mean_received, mean_sold,
    mean_revenue, median_revenue, revenue_variance). A constant side gives a NULL correlation."""
    totals = quantity_totals(star)
    median = (
        quantiles_of(totals, "total_revenue", [0.5], names=["median_revenue"], method=quantiles)
        .select("median_revenue")
        .scalar()
    )
    return totals.agg(
        pearson(F.col("total_sold").cast("double"), F.col("total_received").cast("double")).alias(
            "correlation_received_sold"
        ),
        F.avg("total_received").alias("mean_received"),
        F.avg("total_sold").alias("mean_sold"),
        F.avg("total_revenue").alias("mean_revenue"),
        F.var_samp("total_revenue").alias("revenue_variance"),
    ).select(
        "correlation_received_sold",
        "mean_received",
        "mean_sold",
        "mean_revenue",
        median.alias("median_revenue"),
        "revenue_variance",
    )


STATS = {
    "customer_purchase_stats": customer_purchase_stats,
    "product_profit_margins": product_profit_margins,
    "shipment_delay_stats": shipment_delay_stats,
    "receipt_sales_diff": receipt_sales_diff,
    "receipt_sales_ttest": receipt_sales_ttest,
    "receipt_sales_ttest_ci": receipt_sales_ttest_ci,
    "customer_spending_reg": customer_spending_reg,
    "inventory_turnover_stats": inventory_turnover_stats,
    "credit_rating_summaries": credit_rating_summaries,
    "high_volume_reg_data": high_volume_reg_data,
    "high_volume_reg": high_volume_reg,
    "high_volume_reg_coefficients": high_volume_reg_coefficients,
    "high_volume_reg_residuals": high_volume_reg_residuals,
    "customer_sales_growth": customer_sales_growth,
    "quantity_stats": quantity_stats,
}
