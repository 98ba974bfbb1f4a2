"""Reports on hand-made micro fixtures (expected values computed by hand)."""

from __future__ import annotations

from conftest import d, make_star, rows

from shelfwise.operators import reports as R
from shelfwise.operators import validation as V

GOOD = "Good"


def base_dims():
    customers = [
        (1, "Sam", "Lee", "1 Main St, NY", GOOD),
        (2, "Sam", "Lee", "2 Oak St, CA", "Poor"),
        (3, "Ann", "Bo", "3 Elm St, NY", "Excellent"),
    ]
    products = [
        (10, "widget", 100, 2.0, 5.0),
        (11, "widget", 500, 3.0, 4.0),
        (12, "gadget", 40, 1.0, 2.0),
    ]
    return customers, products


def test_namesakes_merge_by_name_and_split_by_id(spark):
    c, p = base_dims()
    sales = [(100, 5.0, 3, d("2024-01-01"), 10, 1), (101, 4.0, 2, d("2024-01-02"), 11, 2)]
    star = make_star(spark, c, p, sales)
    assert rows(R.customer_sales_summary(star)) == [("Sam Lee", 5)]
    by_id = R.customer_sales_summary(star, customer_key="customer_id")
    assert rows(by_id, "customer_id", "total_purchased") == [(1, 3), (2, 2)]


def test_same_product_name_grain(spark):
    c, p = base_dims()
    shipments = [(1, 100, d("2024-01-02"), 4, 10), (2, 101, d("2024-01-03"), 6, 11)]
    star = make_star(spark, c, p, shipments=shipments)
    # by name: one row; by id (receipts_vs_shipments): one row per product id
    assert rows(R.product_shipment_totals(star)) == [("widget", 10)]
    assert rows(R.receipts_vs_shipments(star)) == [("gadget", 0, 0), ("widget", 0, 4), ("widget", 0, 6)]


def test_null_last_name_gives_null_full_name(spark):
    c = [(1, "Sam", None, "x, NY", GOOD)]
    _, p = base_dims()
    sales = [(100, 1.0, 2, d("2024-01-01"), 10, 1)]
    star = make_star(spark, c, p, sales)
    assert rows(R.customer_sales_summary(star)) == [(None, 2)]


def test_fan_out_doubles_revenue_in_full_sales_summary_only(spark):
    c, p = base_dims()
    sales = [(100, 5.0, 3, d("2024-01-01"), 10, 1)]
    shipments = [(1, 100, d("2024-01-02"), 1, 10), (2, 100, d("2024-01-03"), 2, 10)]
    star = make_star(spark, c, p, sales, shipments)
    assert rows(R.full_sales_summary(star)) == [("Sam Lee", "widget", 3, 30.0)]
    assert rows(R.good_credit_purchases(star)) == [("Sam Lee", "widget", 15.0)]


def test_unshipped_counts_null_sales_id(spark):
    c, p = base_dims()
    sales = [(None, 1.0, 1, d("2024-01-01"), 10, 1), (100, 1.0, 1, d("2024-01-01"), 10, 1),
             (101, 1.0, 1, d("2024-01-01"), 10, 1)]
    shipments = [(1, 100, d("2024-01-01"), 1, 10), (2, 100, d("2024-01-02"), 1, 10)]
    star = make_star(spark, c, p, sales, shipments)
    assert rows(R.unshipped_sales(star), "sales_id") == [(None,), (101,)]
    assert V.validate_unshipped(star).first()["unshipped_sales"] == 2


def test_quantity_match_ignores_null_and_empty_is_null(spark):
    c, p = base_dims()
    sales = [(100, 1.0, 2, d("2024-01-01"), 10, 1)]
    shipments = [(1, 100, d("2024-01-01"), 2, 10), (2, 100, d("2024-01-01"), 3, 10),
                 (3, 100, d("2024-01-01"), None, 10)]
    star = make_star(spark, c, p, sales, shipments)
    r = V.validate_qty_match(star).first()
    assert (r["matched_rows"], r["mismatched_rows"]) == (1, 1)
    empty = make_star(spark, c, p, sales, [])
    r = V.validate_qty_match(empty).first()
    assert (r["matched_rows"], r["mismatched_rows"]) == (None, None)
    assert V.validate_delayed(empty).first()["delayed_shipments"] == 0


def test_delay_is_strictly_later(spark):
    c, p = base_dims()
    sales = [(100, 1.0, 1, d("2024-01-10"), 10, 1)]
    shipments = [(1, 100, d("2024-01-10"), 1, 10), (2, 100, d("2024-01-09"), 1, 10),
                 (3, 100, d("2024-01-13"), 1, 10)]
    star = make_star(spark, c, p, sales, shipments)
    assert rows(R.shipment_delays(star)) == [("Sam Lee", d("2024-01-10"), d("2024-01-13"), 3)]
    assert V.validate_delayed(star).first()["delayed_shipments"] == 1


def test_receipt_same_day_is_not_prior(spark):
    c, p = base_dims()
    sales = [(100, 1.0, 1, d("2024-01-10"), 10, 1), (101, 1.0, 1, d("2024-01-11"), 10, 1)]
    receipts = [(1, 10, d("2024-01-10"), 5), (2, 10, d("2024-01-12"), 5)]
    star = make_star(spark, c, p, sales, receipts=receipts)
    assert rows(R.sales_with_receipts(star)) == [("widget", d("2024-01-11"), d("2024-01-10"))]


def test_two_receipts_one_high_value_day(spark):
    c, p = base_dims()
    sales = [(100, 300.0, 1, d("2024-01-10"), 10, 1), (101, 300.0, 1, d("2024-01-10"), 10, 2),
             (102, 300.0, 1, d("2024-01-11"), 10, 2)]
    receipts = [(1, 10, d("2024-01-10"), 5), (2, 10, d("2024-01-10"), 7), (3, 10, d("2024-01-11"), 1)]
    star = make_star(spark, c, p, sales, receipts=receipts)
    assert rows(R.high_value_receipts(star)) == [("widget", d("2024-01-10"), 600.0)] * 2


def test_top_k_tie_breaks_on_customer_id(spark):
    customers = [(i, f"F{i}", f"L{i}", "a, NY", GOOD) for i in range(1, 8)]
    _, p = base_dims()
    spend = {1: 70.0, 2: 60.0, 3: 50.0, 4: 40.0, 5: 30.0, 6: 30.0, 7: 10.0}
    sales = [(100 + i, v, 1, d("2024-01-01"), 10, i) for i, v in spend.items()]
    sales.append((999, 1000.0, 1, d("2024-01-01"), 10, 42))  # orphan customer id: cannot rank
    star = make_star(spark, customers, p, sales)
    out = [tuple(r) for r in R.top_customer_spending(star).collect()]
    assert out == [("F1 L1", 70.0), ("F2 L2", 60.0), ("F3 L3", 50.0), ("F4 L4", 40.0), ("F5 L5", 30.0)]


def test_distinct_pairs_sorted_by_unselected_last_name(spark):
    customers = [(1, "Zed", "Adams", "x", GOOD), (2, "Amy", "Young", "x", GOOD), (3, "Bob", "Moore", "x", GOOD)]
    _, p = base_dims()
    sales = [(1, 1.0, 1, d("2024-01-01"), 12, 2), (2, 1.0, 1, d("2024-01-01"), 10, 2),
             (3, 1.0, 1, d("2024-01-01"), 10, 1), (4, 1.0, 1, d("2024-01-02"), 10, 1),
             (5, 1.0, 1, d("2024-01-01"), 11, 3)]
    star = make_star(spark, customers, p, sales)
    out = [tuple(r) for r in R.customer_purchase_patterns(star).collect()]
    assert out == [("Zed Adams", 10), ("Bob Moore", 11), ("Amy Young", 10), ("Amy Young", 12)]


def test_region_receipts_and_low_stock_and_profit(spark):
    c, p = base_dims()
    sales = [(100, 5.0, 3, d("2024-01-01"), 10, 1), (101, 2.0, 1, d("2024-01-01"), 12, 3),
             (102, 4.0, 2, d("2024-01-01"), 11, 2)]
    shipments = [(1, 100, d("2024-01-02"), 60, 10), (2, 101, d("2024-01-02"), 30, 12)]
    receipts = [(1, 10, d("2024-09-05"), 7), (2, 10, d("2024-08-01"), 3)]
    star = make_star(spark, c, p, sales, shipments, receipts)
    assert rows(R.region_customer_receipts(star)) == [("Ann Bo", "gadget", 0), ("Sam Lee", "widget", 10)]
    # inventory 100 - 60 = 40 < 50; gadget 40 - 30 = 10 < 50
    assert rows(R.low_stock_sales(star)) == [("gadget", 30, 10), ("widget", 60, 40)]
    # widget 10: (5-2)*60 = 180 > 100; gadget 12: (2-1)*30 = 30
    assert rows(R.profitable_products(star)) == [("widget", 60, 180.0)]
    assert rows(R.recent_receipts(star)) == [("widget", d("2024-09-05"))]
    assert rows(R.low_inventory_sales(star)) == [("gadget", 1, 2.0), ("widget", 3, 15.0)]
    assert rows(R.unsold_products(star)) == []
    assert rows(R.unsold_products(star, sold_since="2024-06-01")) == [("gadget", 40), ("widget", 100), ("widget", 500)]
    assert rows(R.shipments_by_credit(star)) == [("Excellent", 30), ("Good", 60)]


def test_orphans_count_null_keys(spark):
    c, p = base_dims()
    sales = [(100, 1.0, 1, d("2024-01-01"), 10, 99), (101, 1.0, 1, d("2024-01-01"), None, 1)]
    shipments = [(1, 555, d("2024-01-01"), 1, 10)]
    receipts = [(1, 77, d("2024-01-01"), 1)]
    star = make_star(spark, c, p, sales, shipments, receipts)
    r = V.validate_orphans(star).first().asDict()
    assert r == {"sales_missing_customer": 1, "sales_missing_product": 1,
                 "shipments_missing_sale": 1, "receipts_missing_product": 1}


def test_validate_tables_and_counts(spark):
    c, p = base_dims()
    star = make_star(spark, c, p)
    assert all(r["present"] and r["schema_ok"] for r in V.validate_tables(spark, star).collect())
    counts = dict((r["tbl"], r["row_count"]) for r in V.validate_row_counts(star).collect())
    assert counts == {"Customers": 3, "Products": 3, "Sales_Invoices": 0, "Shipments": 0, "Receipts": 0}
