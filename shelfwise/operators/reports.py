"""The twenty retail reports, as lazy DataFrame operators.

Conventions
* ``op(star, **params) -> DataFrame``; the reference's literals are the parameter defaults.
* Dimensions are never force-broadcast: at the target scale Customers and Products hold
  billions of rows. Spark broadcasts them only below the configured, measured size limits.
* Facts are pre-aggregated on the join key before the join wherever the result only needs
  sums or counts of the fact rows (map-side combine removes key skew before the shuffle).
* ``ordered=True`` reproduces the reference's ORDER BY. Sort keys get extra tiebreak columns
  (ties are unordered in the reference): that fixes the output order, and the range partitioner
  can then split a hot sort value across several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import days_between, line_value
from shelfwise.operators.facts import (
    customer_grain,
    customers_named,
    product_balance,
    products_named,
    received_by_product,
    shipped_by_product,
    with_shipped,
)
from shelfwise.sources.star import Star


def _date(value) -> F.Column:
    return F.lit(value).cast("date")


# 1
def customer_sales_summary(star: Star, customer_key: str = "full_name") -> DataFrame:
    """Units purchased per customer -> (full_name, total_purchased).

    Grain is the full name by default (namesakes merge, as in the reference);
    ``customer_key='customer_id'`` keeps customers apart.
    """
    per_customer = star.sales.groupBy("customer_id").agg(
        F.sum("quantity").alias("total_purchased")
    )
    joined = customers_named(star).join(per_customer, "customer_id")
    return joined.groupBy(*customer_grain(customer_key)).agg(
        F.sum("total_purchased").alias("total_purchased")
    )


# 2
def product_shipment_totals(star: Star) -> DataFrame:
    """Units shipped per product name -> (product_name, total_shipped)."""
    per_product = shipped_by_product(star, "total_shipped")
    joined = products_named(star).join(per_product, "product_id")
    return joined.groupBy("product_name").agg(F.sum("total_shipped").alias("total_shipped"))


# 3
def matched_sales_shipments(star: Star) -> DataFrame:
    """Shipments whose quantity equals the invoiced quantity (row level).

    The quantity equality is part of the equi-join key, so a sale with many shipments is
    spread over several hash partitions instead of one.
    """

    def matched(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        invoiced = sales.select("sales_id", F.col("date").alias("sales_date"), "quantity")
        shipped = shipments.select(
            "sales_id",
            "shipment_id",
            F.col("date").alias("shipment_date"),
            F.col("quantity_sold").alias("quantity"),
        )
        return invoiced.join(shipped, ["sales_id", "quantity"])

    return star.by_sale(matched).select("sales_id", "sales_date", "shipment_id", "shipment_date")


# 4
def good_credit_purchases(star: Star, credit_rating: str = "Good") -> DataFrame:
    """Invoice lines of customers with one credit rating -> (full_name, product_name, total_cost)."""
    customers = (
        customers_named(star, "credit_rating")
        .filter(F.col("credit_rating") == credit_rating)
        .drop("credit_rating")
    )
    lines = star.sales.select("customer_id", "product_id", line_value().alias("total_cost"))
    return (
        lines.join(customers, "customer_id")
        .join(products_named(star), "product_id")
        .select("full_name", "product_name", "total_cost")
    )


# 5
def recent_receipts(star: Star, after: str = "2024-09-01", ordered: bool = True) -> DataFrame:
    """Receipts strictly after ``after``, newest first -> (product_name, receipt_date).

    The date filter reaches the Parquet scan (PushedFilters) before the join.
    """
    receipts = star.receipts.filter(F.col("date") > _date(after)).select(
        "product_id", F.col("date").alias("receipt_date")
    )
    out = receipts.join(products_named(star), "product_id").select("product_name", "receipt_date")
    if ordered:
        out = out.orderBy(F.col("receipt_date").desc(), "product_name")
    return out


# 6
def customer_shipments(star: Star, ordered: bool = True) -> DataFrame:
    """Every shipment with its customer, by last name -> (full_name, shipment_date, quantity_sold)."""

    def shipped(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        rows = shipments.select("sales_id", F.col("date").alias("shipment_date"), "quantity_sold")
        return rows.join(sales.select("sales_id", "customer_id"), "sales_id")

    out = star.by_sale(shipped).join(customers_named(star, "last_name"), "customer_id")
    if ordered:
        out = out.orderBy("last_name", "full_name", "shipment_date", "quantity_sold")
    return out.select("full_name", "shipment_date", "quantity_sold")


# 7
def low_inventory_sales(star: Star, max_inventory: int = 200) -> DataFrame:
    """Sales of products with inventory below ``max_inventory``, per product name
    -> (product_name, total_quantity_sold, total_revenue)."""
    low = (
        products_named(star, "inventory_amount")
        .filter(F.col("inventory_amount") < max_inventory)
        .select("product_id", "product_name")
    )
    per_product = star.sales.groupBy("product_id").agg(
        F.sum("quantity").alias("q"), F.sum(line_value()).alias("v")
    )
    return (
        low.join(per_product, "product_id")
        .groupBy("product_name")
        .agg(F.sum("q").alias("total_quantity_sold"), F.sum("v").alias("total_revenue"))
    )


# 8
def region_customer_receipts(
    star: Star,
    address_pattern: str = "%NY%",
    include_purchased: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Products bought by customers whose address matches ``address_pattern`` (SQL LIKE), with
    the product's total receipts -> (full_name, product_name, total_quantity_received).

    Invoices are reduced to one row per (customer, product) before the customer join, so neither a
    hot customer nor the invoices themselves cross it. Receipts are pre-aggregated per product, so the left join cannot fan out.
    """
    region = (
        customers_named(star, "address")
        .filter(F.col("address").like(address_pattern))
        .select("customer_id", "full_name")
    )
    bought = (
        star.sales.groupBy("customer_id", "product_id")
        .agg(F.sum("quantity").alias("q"))
        .join(region, "customer_id")
        .groupBy("product_id", "full_name")
        .agg(F.sum("q").alias("total_quantity_purchased"))
    )
    out = (
        bought.join(products_named(star), "product_id")
        .join(received_by_product(star), "product_id", "left")
        .select(
            "full_name",
            "product_name",
            F.coalesce(F.col("total_received"), F.lit(0)).alias("total_quantity_received"),
            "total_quantity_purchased",
        )
    )
    if ordered:
        out = out.orderBy("full_name", "product_name", "total_quantity_received")
    if not include_purchased:
        out = out.drop("total_quantity_purchased")
    return out


# 9
def unshipped_sales(star: Star) -> DataFrame:
    """Invoices without any shipment -> (sales_id, date, quantity).

    Anti join against the *distinct* shipped sales ids: the dedup is a map-side aggregate,
    so a sale with millions of shipments costs one row in the shuffle. A NULL sales_id never
    matches and is reported as unshipped, as with LEFT JOIN ... IS NULL.
    """

    def unshipped(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        return sales.join(shipments.select("sales_id").distinct(), "sales_id", "left_anti")

    return star.by_sale(unshipped).select("sales_id", "date", "quantity")


# 10
def profitable_products(star: Star, min_profit: float = 100) -> DataFrame:
    """Products whose shipped gross profit exceeds ``min_profit``
    -> (product_name, total_quantity_sold, total_profit), per product id."""
    per_product = shipped_by_product(star, "q")
    joined = products_named(star, "selling_price", "cost").join(per_product, "product_id")
    return (
        joined.groupBy("product_id", "product_name")
        .agg(
            F.sum("q").alias("total_quantity_sold"),
            F.sum((F.col("selling_price") - F.col("cost")) * F.col("q")).alias("total_profit"),
        )
        .filter(F.col("total_profit") > min_profit)
        .select("product_name", "total_quantity_sold", "total_profit")
    )


# 11
def customer_purchase_patterns(star: Star, ordered: bool = True) -> DataFrame:
    """Distinct (full_name, product_id) pairs ordered by last name -> (full_name, product_id).

    Distinct (customer, product) pairs are formed before the customer join (map-side dedup).
    The sort key ``last_name`` is not an output column; it is carried as ``min(last_name)`` of
    each output row, then dropped after the sort.
    """
    pairs = star.sales.select("customer_id", "product_id").distinct()
    out = (
        pairs.join(customers_named(star, "last_name"), "customer_id")
        .groupBy("full_name", "product_id")
        .agg(F.min("last_name").alias("_last_name"))
    )
    if ordered:
        out = out.orderBy("_last_name", "product_id", "full_name")
    return out.select("full_name", "product_id")


# 12
def receipts_vs_shipments(star: Star, ordered: bool = True) -> DataFrame:
    """Units received and shipped per product row -> (product_name, total_received, total_sold)."""
    out = product_balance(star, received_by_product(star), shipped_by_product(star))
    if ordered:
        out = out.orderBy("product_name", "product_id")
    return out.select("product_name", "total_received", "total_sold")


# 13
def top_customer_spending(star: Star, k: int = 5) -> DataFrame:
    """The ``k`` customers (by id) with the highest invoice value -> (full_name, total_spent).

    Spend is aggregated per customer id *before* the customer join; the join is inner (an id
    without a customer row cannot rank), and only then is the top-k taken (one
    TakeOrderedAndProject: each task keeps k rows). Ties break on customer_id.
    """
    per_customer = star.sales.groupBy("customer_id").agg(
        F.sum(line_value()).alias("total_spent")
    )
    return (
        per_customer.join(customers_named(star), "customer_id")
        .orderBy(F.col("total_spent").desc_nulls_last(), F.col("customer_id").asc())
        .limit(k)
        .select("full_name", "total_spent")
    )


# 14
def sales_with_receipts(star: Star) -> DataFrame:
    """Invoices dated strictly after their product's first receipt
    -> (product_name, sales_date, receipt_date).

    The first receipt per product is one row per product; it is joined to the product names
    first (both keyed by product_id), so the invoices are shuffled once.
    """
    first = star.receipts.groupBy("product_id").agg(F.min("date").alias("receipt_date"))
    first_named = first.join(products_named(star), "product_id")
    sales = star.sales.select("product_id", F.col("date").alias("sales_date"))
    return (
        sales.join(first_named, "product_id")
        .filter(F.col("receipt_date") < F.col("sales_date"))
        .select("product_name", "sales_date", "receipt_date")
    )


# 15
def shipments_by_credit(star: Star, ordered: bool = True) -> DataFrame:
    """Units shipped per customer credit rating -> (credit_rating, total_quantity_sold).

    Shipments -> per sale, then per customer, then per rating: three map-side-combined
    aggregates, so neither a hot sale nor a hot customer skews a join.
    """
    shipped = with_shipped(star, lambda sales: sales.select("sales_id", "customer_id"))
    per_customer = shipped.groupBy("customer_id").agg(F.sum("quantity_shipped").alias("q"))
    out = (
        per_customer.join(star.customers.select("customer_id", "credit_rating"), "customer_id")
        .groupBy("credit_rating")
        .agg(F.sum("q").alias("total_quantity_sold"))
    )
    if ordered:
        out = out.orderBy("credit_rating")
    return out


# 16
def unsold_products(star: Star, sold_since: str | None = None) -> DataFrame:
    """Products with no invoice (on or after ``sold_since`` when given)
    -> (product_name, inventory_amount)."""
    sales = star.sales
    if sold_since is not None:
        sales = sales.filter(F.col("date") >= _date(sold_since))
    sold = sales.select("product_id").distinct()
    return (
        products_named(star, "inventory_amount")
        .join(sold, "product_id", "left_anti")
        .select("product_name", "inventory_amount")
    )


# 17
def shipment_delays(star: Star) -> DataFrame:
    """Shipments later than their invoice
    -> (full_name, sales_date, shipment_date, delay_days BIGINT)."""

    def late(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        shipped = shipments.select("sales_id", F.col("date").alias("shipment_date"))
        invoiced = sales.select("sales_id", "customer_id", F.col("date").alias("sales_date"))
        return shipped.join(invoiced, "sales_id").filter(F.col("shipment_date") > F.col("sales_date"))

    return (
        star.by_sale(late)
        .join(customers_named(star), "customer_id")
        .select(
            "full_name",
            "sales_date",
            "shipment_date",
            days_between("shipment_date", "sales_date").alias("delay_days"),
        )
    )


# 18
def high_value_receipts(star: Star, min_value: float = 500) -> DataFrame:
    """Receipts on a day when the product's invoice value exceeded ``min_value``
    -> (product_name, receipt_date, total_sales_value), one row per receipt.

    Sales are aggregated per (product, day) and filtered before the composite-key join.
    """
    daily = (
        star.sales.groupBy("product_id", F.col("date").alias("receipt_date"))
        .agg(F.sum(line_value()).alias("total_sales_value"))
        .filter(F.col("total_sales_value") > min_value)
    )
    receipts = star.receipts.select("product_id", F.col("date").alias("receipt_date"))
    return (
        receipts.join(daily, ["product_id", "receipt_date"])
        .join(products_named(star), "product_id")
        .select("product_name", "receipt_date", "total_sales_value")
    )


# 19
def low_stock_sales(star: Star, threshold: int = 50) -> DataFrame:
    """Products whose inventory minus units shipped is below ``threshold``
    -> (product_name, total_sold, remaining_inventory). Never-shipped products are absent."""
    return (
        products_named(star, "inventory_amount")
        .join(shipped_by_product(star), "product_id")
        .select(
            "product_name",
            "total_sold",
            (F.col("inventory_amount") - F.col("total_sold")).alias("remaining_inventory"),
        )
        .filter(F.col("remaining_inventory") < threshold)
    )


# 20
def full_sales_summary(star: Star, ordered: bool = True) -> DataFrame:
    """Units shipped and invoice value per (customer, product) of the invoice
    -> (full_name, product_name, total_quantity_sold, total_revenue).

    Reference semantics kept: an invoice with k shipments contributes its value k times.
    Shipments are first collapsed per sale (count and quantity), so the fact-fact join is
    one-to-one on sales_id and the value is weighted by the shipment count.
    """
    lines = lambda sales: sales.select("sales_id", "customer_id", "product_id", line_value().alias("v"))
    per_pair = (
        with_shipped(star, lines)
        .groupBy("customer_id", "product_id")
        .agg(
            F.sum("quantity_shipped").alias("total_quantity_sold"),
            F.sum(F.col("v") * F.col("n_shipments")).alias("total_revenue"),
        )
    )
    out = (
        per_pair.join(customers_named(star), "customer_id")
        .join(products_named(star), "product_id")
        .select("full_name", "product_name", "total_quantity_sold", "total_revenue")
    )
    if ordered:
        out = out.orderBy(F.col("total_revenue").desc(), "full_name", "product_name")
    return out


REPORTS = {
    "customer_sales_summary": customer_sales_summary,
    "product_shipment_totals": product_shipment_totals,
    "matched_sales_shipments": matched_sales_shipments,
    "good_credit_purchases": good_credit_purchases,
    "recent_receipts": recent_receipts,
    "customer_shipments": customer_shipments,
    "low_inventory_sales": low_inventory_sales,
    "region_customer_receipts": region_customer_receipts,
    "unshipped_sales": unshipped_sales,
    "profitable_products": profitable_products,
    "customer_purchase_patterns": customer_purchase_patterns,
    "receipts_vs_shipments": receipts_vs_shipments,
    "top_customer_spending": top_customer_spending,
    "sales_with_receipts": sales_with_receipts,
    "shipments_by_credit": shipments_by_credit,
    "unsold_products": unsold_products,
    "shipment_delays": shipment_delays,
    "high_value_receipts": high_value_receipts,
    "low_stock_sales": low_stock_sales,
    "full_sales_summary": full_sales_summary,
}
