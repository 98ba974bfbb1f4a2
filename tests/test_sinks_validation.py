"""Sink output format and the validation report's pass/fail logic."""

from __future__ import annotations

import csv
import glob
import os

import pytest
from conftest import d, make_star
from pyspark.sql import functions as F

from shelfwise import files, session
from shelfwise.functions.rounding import round_numeric
from shelfwise.operators.validation import validation_report
from shelfwise.sinks import write_result


def test_write_result_csv_rounds_and_writes_na(spark, scratch):
    df = spark.createDataFrame([("a", 1.005, None), ("b", 2.0, 3)], "k string, v double, n int")
    path = write_result(df, scratch, "out")
    lines = []
    for f in sorted(glob.glob(os.path.join(path, "part-*.csv"))):
        lines += [x for x in open(f).read().splitlines() if x != "k,v,n"]
    assert sorted(lines) == ["a,1.01,NA", "b,2.0,3"]
    pq = write_result(df, scratch, "outpq", fmt="parquet")
    assert sorted(r["v"] for r in spark.read.parquet(pq).collect()) == [1.01, 2.0]


def test_one_csv_file_in_row_order(spark, scratch):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("id", "cast(id AS double) / 8 AS v", "nullif(id % 3, 0) AS n", "concat('a,', id) AS s")
    path = write_result(df.orderBy(F.desc("id")), scratch, "Ordered", fmt="csv_file", mode="nearest")
    assert path == os.path.join(scratch, "Ordered.csv") and os.path.isfile(path)
    with open(path) as fh:
        rows = list(csv.reader(fh))
    assert rows[0] == ["id", "v", "n", "s"] and [int(r[0]) for r in rows[1:]] == list(range(4999, -1, -1))
    assert rows[1] == ["4999", "624.88", "1", "a,4999"] and rows[2][2] == "NA"
    assert [f for f in os.listdir(scratch) if not f.startswith(".")] == ["Ordered.csv"]  # no parts, nothing staged


def test_one_csv_file_of_no_rows_and_replaced_results(spark, scratch):
    empty = spark.createDataFrame([], "a long, `b c` string")
    path = write_result(empty, scratch, "out", fmt="csv_file")
    assert open(path).read() == "a,b c\n"
    write_result(spark.createDataFrame([(1, "x")], "a long, `b c` string"), scratch, "out", fmt="csv_file")
    assert open(path).read() == "a,b c\n1,x\n"


@pytest.mark.parametrize("fmt", ["csv", "csv_file", "parquet"])
def test_a_failed_write_leaves_what_was_there(spark, scratch, fmt):
    good = spark.createDataFrame([(1,)], "a long")
    path = write_result(good, scratch, "out", fmt=fmt)
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(scratch) for f in fs}
    with pytest.raises(Exception):
        write_result(good.selectExpr("raise_error('broken') AS a"), scratch, "out", fmt=fmt)
    assert before == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(scratch) for f in fs}
    assert os.path.exists(path)


def test_files_of_a_store(spark, scratch):
    base = os.path.join(scratch, "store")
    assert not files.exists(spark, base) and files.listing(spark, base) == [] and files.total_bytes(spark, base) == 0
    for name in ("b.txt", "a.txt"):
        files.write_text(spark, f"{base}/{name}", f"text of {name}\n")
    files.write_text(spark, f"{base}/_hidden", "x")
    assert files.read_text(spark, f"{base}/a.txt") == "text of a.txt\n" and files.read_text(spark, f"{base}/no") is None
    assert [os.path.basename(f.path) for f in files.listing(spark, base)] == ["a.txt", "b.txt"]
    files.join_files(spark, [f.path for f in files.listing(spark, base)], f"{base}/all.txt")
    assert files.read_text(spark, f"{base}/all.txt") == "text of a.txt\ntext of b.txt\n"
    files.publish(spark, f"{base}/a.txt", f"{base}/all.txt")
    assert files.read_text(spark, f"{base}/all.txt") == "text of a.txt\n"
    files.remove(spark, base)
    assert not files.exists(spark, base)


def test_intermediates_are_removed_and_no_folder_is_left(spark):
    before = set(glob.glob("/tmp/shelfwise-*"))
    with session.intermediates(spark) as paths:
        assert session.pinned(spark.range(3), "probe").count() == 3
        assert len(paths) == 1 and files.exists(spark, paths[0])
        [session.shared_dir(spark) for _ in range(5)]
    assert not files.exists(spark, paths[0])
    assert set(glob.glob("/tmp/shelfwise-*")) == before


def test_round_numeric_keeps_decimal_type(spark):
    df = spark.createDataFrame([(1,)], "x int").selectExpr("CAST(1.235 AS DECIMAL(10,3)) AS m")
    out = round_numeric(df, 2)
    assert out.schema["m"].dataType.simpleString().startswith("decimal")
    assert float(out.first()["m"]) == 1.24


def test_validation_report_flags(spark):
    customers = [(1, "A", "B", "x", "Good")]
    products = [(10, "w", 100, 1.0, 2.0)]
    # 10 invoices, 1 unshipped (10 %), 1 of 9 shipments mismatched (11 %), 1 late, no orphans
    sales = [(i, 1.0, 2, d("2024-01-01"), 10, 1) for i in range(10)]
    shipments = [(i, i, d("2024-01-01"), 2, 10) for i in range(8)]
    shipments.append((8, 8, d("2024-01-05"), 3, 10))
    star = make_star(spark, customers, products, sales, shipments)
    rows = {(r["check"], r["metric"]): r for r in validation_report(star).collect()}
    assert rows[("unshipped_sales", "unshipped_pct")]["value"] == 10.0
    assert rows[("unshipped_sales", "unshipped_pct")]["passed"] is True
    assert rows[("delayed_shipments", "delayed_shipments")]["value"] == 1.0
    q = rows[("quantity_match", "mismatch_pct")]
    assert abs(q["value"] - 100 / 9) < 1e-9 and q["passed"] is False  # 11.1 % is not ~4 % (+-5)
    assert all(r["passed"] for (c, _), r in rows.items() if c == "orphans")
    assert rows[("row_counts", "Receipts")]["passed"] is False  # no receipts loaded


def test_orphans_of_all_kinds_and_counts(spark):
    from shelfwise.operators.validation import validate_orphans

    customers, products = [(1, "A", "B", "x", "Good")], [(10, "w", 100, 1.0, 2.0)]
    sales = [(1, 1.0, 2, d("2024-01-01"), 10, 1), (2, 1.0, 2, d("2024-01-01"), 10, 7),
             (3, 1.0, 2, d("2024-01-01"), 77, None), (4, 1.0, 2, d("2024-01-01"), 10, 1)]
    shipments = [(1, 1, d("2024-01-02"), 2, 10), (2, 1, d("2024-01-01"), 5, 10), (3, 99, d("2024-01-01"), 2, 10),
                 (4, None, d("2024-01-01"), 2, 10), (5, 98, d("2024-01-01"), 2, 10)]
    receipts = [(i, pid, d("2024-01-01"), 1) for i, pid in enumerate([10, 88, None, 88, 87])]
    star = make_star(spark, customers, products, sales, shipments, receipts)
    orphans = validate_orphans(star).first().asDict()
    assert list(orphans.values()) == [2, 1, 3, 4]
    report = {r["metric"]: r["value"] for r in validation_report(star).collect()}
    assert len(report) == 15
    assert {k: report[k] for k in orphans} == {k: float(v) for k, v in orphans.items()}
    assert (report["unshipped_sales"], report["delayed_shipments"]) == (3.0, 1.0)
    assert (report["matched_rows"], report["mismatched_rows"]) == (1.0, 1.0)
    assert (report["Sales_Invoices"], report["Shipments"], report["Receipts"]) == (4.0, 5.0, 5.0)
