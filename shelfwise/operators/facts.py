"""Shared projections and pre-aggregations of the star schema.

Pre-aggregating a fact table on its join key *before* joining is the main scale device here:
the partial aggregate runs map-side, so a hot key (one product or customer holding a third of
all rows) reaches the shuffle as one row per map task instead of millions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import regression as ols
from shelfwise.functions.columns import epoch_days, full_name, line_value
from shelfwise.sources.star import Star

CUSTOMER_KEYS = ("full_name", "customer_id")


def check_customer_key(customer_key: str) -> None:
    if customer_key not in CUSTOMER_KEYS:
        raise ValueError(f"customer_key must be one of {CUSTOMER_KEYS}, got {customer_key!r}")


def customer_grain(customer_key: str) -> list[str]:
    """Grouping columns of a per-customer result: the name (reference parity) or the id."""
    check_customer_key(customer_key)
    return ["full_name"] if customer_key == "full_name" else ["customer_id", "full_name"]


def customers_named(star: Star, *extra: str) -> DataFrame:
    return star.customers.select("customer_id", full_name().alias("full_name"), *extra)


def products_named(star: Star, *extra: str) -> DataFrame:
    return star.products.select("product_id", "product_name", *extra)


def received_by_product(star: Star) -> DataFrame:
    return star.shared(
        "received_by_product",
        lambda: star.receipts.groupBy("product_id").agg(
            F.sum("quantity_received").alias("total_received")
        ),
    )


def _sales_aggregates() -> list[Column]:
    """What the analyses need of a set of invoices: value, units and the moments of quantity,
    line value ~ quantity (``_s``) and line value ~ invoice day (``_g``)."""
    q = F.col("quantity").cast("double")
    return [
        F.count(F.lit(1)).alias("_rows"),
        F.sum(line_value()).alias("value"),
        F.sum("quantity").alias("units"),
        *ols.centred_moments(q, q, "_q"),
        *ols.centred_moments(line_value(), q, "_s"),
        *ols.centred_moments(line_value(), epoch_days("date"), "_g"),
    ]


def sales_totals(star: Star) -> DataFrame:
    """:func:`_sales_aggregates` per customer id and per product id from one scan of the invoices
    (``per`` says which); attach it as ``sales_totals`` and both lookups below read it.

    A task of the scan meets nearly as many keys as rows, so combining there would hold, and shuffle, a wide
    row of moments for almost every invoice and key. Instead the narrow invoices are brought together by
    key first. The partitions are rebalanced, so AQE splits that of a hot key, and each is then combined:
    what a task holds, and the second shuffle, is about one wide row per key.
    """
    entry = lambda key: F.struct(F.lit(key == "customer_id").alias("customer"), F.col(key).alias("id"))
    keys = F.explode(F.array(entry("customer_id"), entry("product_id"))).alias("_key")
    dealt = star.sales.select(keys, "quantity", "unit_price", "date").hint("rebalance", "_key")
    # Grouping by the entry's fields does not count as grouped by the entry: a split key is combined again.
    totals = dealt.groupBy(F.col("_key.customer").alias("_customer"), F.col("_key.id").alias("_id")).agg(*_sales_aggregates())
    return totals.select(
        F.when(F.col("_customer"), F.col("_id")).alias("customer_id"),
        F.when(~F.col("_customer"), F.col("_id")).alias("product_id"),
        F.when(F.col("_customer"), "customer_id").otherwise("product_id").alias("per"),
        *totals.columns[2:],
    )


def _sales_by(star: Star, key: str) -> DataFrame:
    if "sales_totals" in star.aggregates:
        totals = star.aggregates["sales_totals"].filter(F.col("per") == key)
        return totals.drop("per", "product_id" if key == "customer_id" else "customer_id")
    return star.sales.groupBy(key).agg(*_sales_aggregates())


def sales_by_customer(star: Star) -> DataFrame:
    return _sales_by(star, "customer_id")


def sales_by_product(star: Star) -> DataFrame:
    return _sales_by(star, "product_id")


def shipments_by_product(star: Star) -> DataFrame:
    """Units shipped and the moments of the shipped quantity (``_t``) per product id."""
    q = F.col("quantity_sold").cast("double")
    return star.shared(
        "shipments_by_product",
        lambda: star.shipments.groupBy("product_id").agg(
            F.sum("quantity_sold").alias("total_sold"), *ols.centred_moments(q, q, "_t")
        ),
    )


def shipped_by_product(star: Star, name: str = "total_sold") -> DataFrame:
    return shipments_by_product(star).select("product_id", F.col("total_sold").alias(name))


def invoiced_by_product(star: Star) -> DataFrame:
    return sales_by_product(star).select("product_id", F.col("units").alias("total_sold"))


def revenue_by_product(star: Star) -> DataFrame:
    return sales_by_product(star).select("product_id", F.col("value").alias("total_revenue"))


def product_balance(star: Star, *per_product: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every product row left-joined to per-product totals, missing totals as 0.

    Each input is already one row per ``product_id``, so the left joins cannot fan out.
    """
    out = products_named(star, *extra)
    value_cols: list[str] = []
    for agg in per_product:
        out = out.join(agg, "product_id", "left")
        value_cols += [c for c in agg.columns if c != "product_id"]
    return out.select(
        "product_id",
        "product_name",
        *extra,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in value_cols],
    )


def per_sale(shipments: DataFrame, *keys: str) -> DataFrame:
    """Shipments collapsed to one row per (sales_id, *keys) with their count and quantity.

    Joining invoices to this instead of to raw shipments gives the same sums and counts as the
    row-level join, while a sale with millions of shipments arrives as a handful of rows.
    """
    ship = shipments.select("sales_id", "quantity_sold", F.col("date").alias("shipment_date"))
    return ship.groupBy("sales_id", *keys).agg(
        F.count(F.lit(1)).alias("n_shipments"),
        F.sum("quantity_sold").alias("quantity_shipped"),
    )


def shipments_per_sale(star: Star) -> DataFrame:
    return star.shared(
        "shipments_per_sale", lambda: star.by_sale(lambda _, shipments: per_sale(shipments))
    )


def with_shipped(star: Star, invoices: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``invoices(sales)`` (which keeps ``sales_id``) joined to the shipments of each sale."""
    if "shipments_per_sale" in star.aggregates:
        return invoices(star.sales).join(star.aggregates["shipments_per_sale"], "sales_id")
    return star.by_sale(lambda sales, shipments: invoices(sales).join(per_sale(shipments), "sales_id"))


def late_shipments(star: Star) -> DataFrame:
    """(shipment_date, sales_date, n): shipments dated after their invoice, counted per sale and day. A
    stored state (see :mod:`shelfwise.plans.incremental`) may have them summed up."""

    def late(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        per_day = shipments.groupBy("sales_id", F.col("date").alias("shipment_date")).agg(
            F.count(F.lit(1)).alias("n")
        )
        invoiced = sales.select("sales_id", F.col("date").alias("sales_date"))
        return per_day.join(invoiced, "sales_id").filter(F.col("shipment_date") > F.col("sales_date"))

    return star.shared(
        "late_shipments", lambda: star.by_sale(late).select("shipment_date", "sales_date", "n")
    )
