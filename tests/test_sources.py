"""Readers: CSV by header name, quarantine of bad casts, landing, TPC-H fixture counts."""

from __future__ import annotations

import dataclasses
import gzip
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from shelfwise.sources.contracts import PRODUCTS, SALES_INVOICES, ContractError
from shelfwise.sources.landing import bucketed_table_name, hot_sales, land_star, partitions_for, source_bytes
from shelfwise.sources.readers import header_census, load_star, read_csv_table
from shelfwise.sources.tpch_fixture import star_from_tpch

SF = "/root/testdata/sf0.001"


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_products_mapped_by_header_name_not_position(spark, scratch):
    # Header order differs from the contract's column order: values must follow the names.
    path = _write(os.path.join(scratch, "Products.csv"),
                  "product_id,product_name,cost,selling_price,inventory_amount\n1,widget,4.77,9.99,250\n")
    r = read_csv_table(spark, path, PRODUCTS).first()
    assert (r["inventory_amount"], r["cost"], r["selling_price"]) == (250, 4.77, 9.99)


def test_missing_column_is_an_error(spark, scratch):
    path = _write(os.path.join(scratch, "p.csv"), "product_id,product_name,cost\n1,w,2.0\n")
    with pytest.raises(ContractError):
        read_csv_table(spark, path, PRODUCTS)


INVOICES = "sales_id,customer_id,product_id,unit_price,quantity,date\n"


def test_bad_cast_strict_fails_quarantine_keeps(spark, scratch):
    path = _write(os.path.join(scratch, "s.csv"),
                  INVOICES + "1,1,1,2.5,3,2024-01-05\n2,1,1,2.5,x,2024-13-40\n")
    with pytest.raises(PySparkException) as e:
        read_csv_table(spark, path, SALES_INVOICES).collect()
    assert e.value.getCondition() == "CAST_INVALID_INPUT"
    good, bad = read_csv_table(spark, path, SALES_INVOICES, mode="quarantine")
    assert [r["sales_id"] for r in good.collect()] == [1]
    assert [r["sales_id"] for r in bad.collect()] == ["2"]


@pytest.mark.parametrize("line", ["2,1,1,2.5", "2,1,1,2.5,4,2024-01-06,extra"])
def test_wrong_field_count_is_malformed(spark, scratch, line):
    path = _write(os.path.join(scratch, "s.csv"), INVOICES + f"1,1,1,2.5,3,2024-01-05\n{line}\n")
    with pytest.raises(Py4JJavaError) as e:
        read_csv_table(spark, path, SALES_INVOICES).collect()
    assert e.value.java_exception.getCondition() == "FAILED_READ_FILE.NO_HINT"
    good, bad = read_csv_table(spark, path, SALES_INVOICES, mode="quarantine")
    assert [r["sales_id"] for r in good.collect()] == [1]
    assert [r["_corrupt_record"] for r in bad.collect()] == [line]


def _mixed_folder(scratch):
    """Products in three files: columns in two orders, and one file with a column more, packed."""
    folder = os.path.join(scratch, "Products.csv")
    os.makedirs(folder)
    _write(os.path.join(folder, "a.csv"), "product_id,product_name,cost,selling_price,inventory_amount\n1,widget,4.5,9.5,250\n")
    _write(os.path.join(folder, "b.csv"), "\ufeffproduct_id,product_name,inventory_amount,cost,selling_price\n2,\"gizmo, big\",300,5.0,11\n")
    with gzip.open(os.path.join(folder, "c.csv.gz"), "wt") as fh:
        fh.write("Selling_Price,colour,cost,inventory_amount,product_name,product_id\n12,red,6,7,gadget,3\n")
    _write(os.path.join(folder, "empty.csv"), "")
    _write(os.path.join(folder, "only_header.csv"), "cost,product_id,product_name,inventory_amount,selling_price\n")
    return folder


PRODUCT_ROWS = [(1, "widget", 250, 4.5, 9.5), (2, "gizmo, big", 300, 5.0, 11.0), (3, "gadget", 7, 6.0, 12.0)]


def test_part_files_with_other_column_orders_load_by_name(spark, scratch):
    folder = _mixed_folder(scratch)
    assert len(header_census(spark, folder)) == 4
    assert sorted(map(tuple, read_csv_table(spark, folder, PRODUCTS).collect())) == PRODUCT_ROWS
    good, bad = read_csv_table(spark, folder, PRODUCTS, mode="quarantine")
    assert sorted(map(tuple, good.collect())) == PRODUCT_ROWS and bad.count() == 0


def test_a_file_without_a_column_is_quarantined_whole(spark, scratch):
    folder = _mixed_folder(scratch)
    _write(os.path.join(folder, "d.csv"), "product_id,product_name,cost\n4,lamp,1.0\n5,desk,2.0\n")
    _write(os.path.join(folder, "e.csv"), "product_id,product_id,product_name,inventory_amount,cost,selling_price\n6,7,pen,1,2.0,3.0\n")
    _write(os.path.join(folder, "f.csv"), "product_id,product_name,cost,selling_price,inventory_amount\n8,cup,x,9.5,250\n")
    with pytest.raises(ContractError, match="d.csv|e.csv"):
        read_csv_table(spark, folder, PRODUCTS)
    good, bad = read_csv_table(spark, folder, PRODUCTS, mode="quarantine")
    assert sorted(map(tuple, good.collect())) == PRODUCT_ROWS
    rows = bad.collect()
    assert sorted(r["_c1"] for r in rows if r["_c1"]) == ["7", "desk", "lamp"]
    assert [r["product_name"] for r in rows if r["product_name"]] == ["cup"]


def test_a_folder_without_files_is_an_empty_table_and_none_an_error(spark, scratch):
    folder = os.path.join(scratch, "none.csv")
    os.makedirs(folder)
    assert read_csv_table(spark, folder, PRODUCTS).count() == 0
    with pytest.raises(AnalysisException):
        read_csv_table(spark, os.path.join(scratch, "missing.csv"), PRODUCTS)


def test_relanding_without_buckets_replaces_the_bucketed_tables(spark, scratch):
    star, base = star_from_tpch(spark, SF), os.path.join(scratch, "again")
    land_star(spark, star, base, buckets=4)
    files = [f for f in os.listdir(os.path.join(base, "shipments")) if f.endswith(".parquet")]
    assert len(files) == 4
    landed = land_star(spark, star, base)
    assert landed.shipments.count() == star.shipments.count()
    assert load_star(spark, base).sales.count() == star.sales.count()


def _with_hot_sale(star):
    hot = star.sales.first()["sales_id"]
    ids = F.when(F.col("shipment_id") % 3 > 0, F.lit(hot)).when(F.col("shipment_id") % 50 == 0, F.lit(None)).otherwise(F.col("sales_id"))
    return hot, dataclasses.replace(star, shipments=star.shipments.withColumn("sales_id", ids))


def test_hot_sales_are_found_by_sketch_and_count(spark):
    hot, star = _with_hot_sale(star_from_tpch(spark, SF))
    assert hot_sales(star.shipments, 16) == [hot]
    assert hot_sales(star_from_tpch(spark, SF).shipments, 16) == []
    few = spark.createDataFrame([(k,) for k in (1, 1, 1, 1, 1, 2, 3, None, None)], "sales_id long")
    assert hot_sales(few, 7) == [1] and hot_sales(few.limit(0), 7) == []


def test_hot_sale_lies_beside_the_buckets(spark, scratch):
    hot, star = _with_hot_sale(star_from_tpch(spark, SF))
    base = os.path.join(scratch, "hot")
    landed = land_star(spark, star, base, buckets=16)
    (cold_sales, cold_ships), (hot_invoices, hot_ships) = landed.sale_parts
    assert spark.catalog.tableExists(bucketed_table_name(base, "shipments"))
    assert {r[0] for r in hot_ships.select("sales_id").distinct().collect()} == {hot}
    assert hot_invoices.count() == 1 and cold_ships.filter(F.col("sales_id") == hot).count() == 0
    assert cold_ships.filter(F.col("sales_id").isNull()).count() > 0
    for got, want in ((landed.sales, star.sales), (landed.shipments, star.shipments)):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
    assert len(load_star(spark, base).sale_parts) == 2
    # Landed again without hot sales, nothing of them stays behind.
    again = land_star(spark, star_from_tpch(spark, SF), base, buckets=4)
    assert again.sale_parts == () and again.shipments.count() == star.shipments.count()


def test_partition_count_follows_the_source(spark):
    assert partitions_for(1) == 1
    assert partitions_for(100 << 40) == 100 * 4096
    assert source_bytes(spark, SF) == sum(
        os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(SF) for f in fs
    )


def test_tpch_fixture_counts_and_landing_roundtrip(spark, scratch):
    star = star_from_tpch(spark, SF)
    counts = {k: v.count() for k, v in star.tables().items()}
    assert counts == {"customers": 150, "products": 205, "sales_invoices": 4599,
                      "shipments": 3010, "receipts": 1968}
    landed = land_star(spark, star, os.path.join(scratch, "star"))
    assert {k: v.count() for k, v in landed.tables().items()} == counts
    again = load_star(spark, os.path.join(scratch, "star"))
    assert again.sales.schema == star.sales.schema
    assert sorted(again.sales.collect()) == sorted(star.sales.collect())


def test_load_star_reads_csv_drop(spark, scratch):
    _write(os.path.join(scratch, "Customers.csv"),
           'customer_id,first_name,last_name,address,credit_rating\n1,Sam,Lee,"1 Main St, NY",Good\n')
    _write(os.path.join(scratch, "Products.csv"),
           "product_id,product_name,cost,selling_price,inventory_amount\n10,widget,2.0,5.0,100\n")
    _write(os.path.join(scratch, "Sales_Invoices.csv"),
           "sales_id,customer_id,product_id,unit_price,quantity,date\n100,1,10,5.0,3,2024-01-01\n")
    _write(os.path.join(scratch, "Shipments.csv"),
           "shipment_id,sales_id,product_id,quantity_sold,date\n1,100,10,3,2024-01-02\n")
    _write(os.path.join(scratch, "Receipts.csv"),
           "receipt_id,product_id,quantity_received,date\n1,10,7,2023-10-01\n")
    star = load_star(spark, scratch)
    c = star.customers.first()
    assert c["address"] == "1 Main St, NY"
    assert star.products.first()["inventory_amount"] == 100
    assert star.shipments.first()["quantity_sold"] == 3


def test_table_counts_after_load(spark):
    from shelfwise.operators.validation import table_counts

    counts = {r["tbl"]: r["row_count"] for r in table_counts(star_from_tpch(spark, SF)).collect()}
    assert counts["Sales_Invoices"] == 4599 and counts["Receipts"] == 1968


def test_load_star_uses_bucketed_catalog_tables(spark, scratch):
    base = os.path.join(scratch, "bucketed")
    src = star_from_tpch(spark, SF)
    land_star(spark, src, base, buckets=4)
    again = load_star(spark, base)
    # Read through the catalog, so the bucket spec is visible to the planner (a plain scan does
    # not use it; joins on sales_id do -- see test_plans.py).
    buf = __import__("io").StringIO()
    with __import__("contextlib").redirect_stdout(buf):
        again.sales.explain(mode="formatted")
    assert "spark_catalog.default.shelfwise_" in buf.getvalue()
    assert sorted(again.shipments.collect()) == sorted(src.shipments.collect())
