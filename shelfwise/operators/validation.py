"""Post-load data checks: presence, row counts, fulfilment coverage, referential integrity.

Each check is a lazy DataFrame of one or a few rows. Facts are only ever reduced by
aggregates and anti joins against *distinct* keys, so no check materialises fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.checks import (
    POSITIVE,
    ZERO,
    Check,
    about,
    frame_check,
    measure,
    references,
    run_checks,
    sql_check,
)
from shelfwise.operators.facts import late_shipments
from shelfwise.operators.reports import unshipped_sales
from shelfwise.sources.contracts import CONTRACTS, schema_matches
from shelfwise.sources.star import Star

# Display names of the tables in check output (fixed values).
TABLE_LABELS = {
    "customers": "Customers",
    "products": "Products",
    "sales_invoices": "Sales_Invoices",
    "shipments": "Shipments",
    "receipts": "Receipts",
}


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def validate_tables(spark: SparkSession, star: Star) -> DataFrame:
    """(table_name, present, schema_ok) per contract table; reads schemas only, no data."""
    tables = star.tables()
    rows = [
        (
            TABLE_LABELS[name],
            tables.get(name) is not None,
            tables.get(name) is not None and schema_matches(tables[name], CONTRACTS[name]),
        )
        for name in CONTRACTS
    ]
    schema = T.StructType(
        [
            T.StructField("table_name", T.StringType()),
            T.StructField("present", T.BooleanType()),
            T.StructField("schema_ok", T.BooleanType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


def validate_row_counts(star: Star) -> DataFrame:
    """(tbl, row_count) for the five tables, one union of five global counts."""
    parts = [
        _count(df, "row_count").select(F.lit(TABLE_LABELS[name]).alias("tbl"), "row_count")
        for name, df in star.tables().items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_counts(star: Star) -> DataFrame:
    """Row counts right after a load (the load step's report); same table as the check."""
    return validate_row_counts(star)


def validate_unshipped(star: Star) -> DataFrame:
    """(unshipped_sales): invoices with no shipment (the reference expects about 10 %)."""
    return _count(unshipped_sales(star), "unshipped_sales")


def validate_delayed(star: Star) -> DataFrame:
    """(delayed_shipments): shipments dated after their invoice.

    Shipments are first counted per (sale, ship date), so a sale with many shipments joins
    as a few rows; the count is the sum of those multiplicities.
    """
    late = late_shipments(star)
    return late.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("delayed_shipments"))


def validate_qty_match(star: Star) -> DataFrame:
    """(matched_rows, mismatched_rows) over shipment x invoice rows.

    A NULL quantity on either side counts as neither; with no joined rows both are NULL
    (SUM over nothing), as in SQL.
    """

    def quantities(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        per_qty = shipments.groupBy("sales_id", "quantity_sold").agg(F.count(F.lit(1)).alias("n"))
        return per_qty.join(sales.select("sales_id", "quantity"), "sales_id")

    joined = star.by_sale(quantities)
    return joined.agg(
        F.sum(F.when(F.col("quantity_sold") == F.col("quantity"), F.col("n")).otherwise(0)).alias(
            "matched_rows"
        ),
        F.sum(F.when(F.col("quantity_sold") != F.col("quantity"), F.col("n")).otherwise(0)).alias(
            "mismatched_rows"
        ),
    )


def validate_orphans(star: Star) -> DataFrame:
    """One row: sales_missing_customer, sales_missing_product, shipments_missing_sale,
    receipts_missing_product (all expected 0). A NULL key counts as an orphan.

    Invoices are read twice (customer and product ids in one pass, sale ids against the shipments), the
    other tables once. The shipments' count enters as a scalar subquery.
    """

    def unknown_sale(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        known = sales.select("sales_id").distinct()
        return shipments.select("sales_id").join(known, "sales_id", "left_anti")

    lost = _count(star.by_sale(unknown_sale), "shipments_missing_sale").scalar()
    return references(star).agg(
        _unknown("customer", "sales").alias("sales_missing_customer"),
        _unknown("product", "sales").alias("sales_missing_product"),
        _unknown("product", "receipts").alias("receipts_missing_product"),
    ).select(
        "sales_missing_customer",
        "sales_missing_product",
        lost.alias("shipments_missing_sale"),
        "receipts_missing_product",
    )


def _of(kind: str, rows: str, condition: Column | None = None) -> Column:
    """Rows of the :func:`references` of a kind that carry a key for which ``condition`` holds."""
    wanted = F.col("kind") == kind
    return F.coalesce(F.sum(F.when(wanted if condition is None else wanted & condition, F.col(rows))), F.lit(0))


def _unknown(kind: str, rows: str) -> Column:
    return _of(kind, rows, F.col("key").isNull() | (F.col("dimension") == 0))


# Expectations stated by the reference's check titles (fixed values).
EXPECTED_UNSHIPPED_PCT = 10.0
EXPECTED_MISMATCH_PCT = 4.0


def reference_checks(star: Star, tolerance_pct: float = 5.0) -> list[Check]:
    """The checks that follow a load, with the expectations of the reference's check titles: rows in every
    table, about 10 % unshipped, more than 0 delayed, about 4 % mismatched, no orphans."""
    n_sales = star.sales.agg(F.count(F.lit(1)).alias("n")).scalar()
    unshipped = F.count_if(F.col("invoiced") & F.col("n").isNull())
    matched = _total(F.col("quantity_sold") == F.col("quantity"))
    mismatched = _total(F.col("quantity_sold") != F.col("quantity"))
    counted = {
        "customers": _of("customer", "dimension"),
        "products": _of("product", "dimension"),
        "sales_invoices": _of("customer", "sales"),
        "receipts": _of("product", "receipts"),
    }
    return [
        Check("row_counts", {TABLE_LABELS[t]: c for t, c in counted.items()}, "references", expected=POSITIVE),
        Check("row_counts", {TABLE_LABELS["shipments"]: F.count(F.lit(1))}, "shipments", expected=POSITIVE),
        measure(
            "unshipped_sales",
            "sale_matches",
            {"unshipped_pct": about(EXPECTED_UNSHIPPED_PCT, tolerance_pct, "%")},
            unshipped_sales=unshipped,
            unshipped_pct=F.try_divide(unshipped, F.max(n_sales)) * 100,
        ),
        measure(
            "delayed_shipments",
            "sale_matches",
            POSITIVE,
            delayed_shipments=_total(F.col("shipment_date") > F.col("sale_date")),
        ),
        measure(
            "quantity_match",
            "sale_matches",
            {"mismatch_pct": about(EXPECTED_MISMATCH_PCT, tolerance_pct, "%")},
            matched_rows=matched,
            mismatched_rows=mismatched,
            mismatch_pct=F.try_divide(mismatched, matched + mismatched) * 100,
        ),
        measure(
            "orphans",
            "references",
            ZERO,
            sales_missing_customer=_unknown("customer", "sales"),
            sales_missing_product=_unknown("product", "sales"),
            receipts_missing_product=_unknown("product", "receipts"),
        ),
        measure("orphans", "sale_matches", ZERO, shipments_missing_sale=_total(F.col("invoiced").isNull())),
    ]


def validation_report(star: Star, tolerance_pct: float = 5.0, extra: Sequence[Check] = ()) -> DataFrame:
    """(check, metric, value, expectation, passed): :func:`reference_checks` and the caller's ``extra``
    ones as one long table.

    Shares are held against the expectation within ``tolerance_pct`` percentage points. Scans: invoices
    three times at most (customer and product ids, the match with shipments, their count from the file
    footers), shipments twice, the others once; ``extra`` checks on these relations add none.
    """
    return run_checks(star, [*reference_checks(star, tolerance_pct), *extra])


def extra_checks(star: Star) -> DataFrame:
    """:data:`FURTHER_CHECKS` alone, as a report."""
    return run_checks(star, FURTHER_CHECKS)


def _total(condition: Column) -> Column:
    """Sum of the multiplicities ``n`` of the rows where ``condition`` holds."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


#: Checks beyond the reference's, one of each kind: on a table, on a prepared relation, SQL, DataFrame.
FURTHER_CHECKS = [
    measure(
        "invoice_values",
        "sales_invoices",
        {"bad_quantity": ZERO, "bad_price": ZERO, "missing_date": ZERO},
        bad_quantity="count_if(quantity <= 0 OR quantity IS NULL)",
        bad_price="count_if(unit_price < 0 OR unit_price IS NULL)",
        missing_date="count_if(date IS NULL)",
        mean_quantity="avg(quantity)",
    ),
    measure("invoice_days", "sales_invoices", POSITIVE, days="count(DISTINCT date)"),
    measure("split_shipments", "sale_matches", largest="max(n)", days="count_if(n IS NOT NULL)"),
    measure("idle_customers", "references", idle_pct=(
        "100.0 * try_divide(count_if(kind = 'customer' AND sales = 0), count_if(kind = 'customer'))"
    )),
    sql_check(
        "receipts_by_year",
        "SELECT CAST(year(date) AS STRING) AS year, sum(quantity_received) AS units FROM {receipts} GROUP BY 1",
        POSITIVE,
    ),
    frame_check(
        "priced_below_cost",
        lambda star: star.products.agg(F.count_if(F.col("selling_price") < F.col("cost")).alias("products")),
        ZERO,
    ),
]

CHECKS = {
    "validate_row_counts": validate_row_counts,
    "validate_unshipped": validate_unshipped,
    "validate_delayed": validate_delayed,
    "validate_qty_match": validate_qty_match,
    "validate_orphans": validate_orphans,
    "validation_report": validation_report,
    "extra_checks": extra_checks,
}
