"""Batch pipeline: landing, step isolation, written outputs."""

from __future__ import annotations

import glob
import os
import shutil

import pytest

from shelfwise import session
from shelfwise.plans import pipeline
from shelfwise.plans.pipeline import run_pipeline
from shelfwise.plans.registry import OPERATORS

SF = "/root/testdata/sf0.001"


def test_pipeline_isolates_failures_and_writes(spark, scratch):
    out = os.path.join(scratch, "out")
    statuses = run_pipeline(
        spark, SF, out,
        steps=["validation_report", "top_customer_spending", "no_such_step", "statistical_summary"],
        params={"statistical_summary": {"min_received": 300}},
    )
    by = {s.step: s for s in statuses}
    assert by["validation_report"].ok and by["top_customer_spending"].ok and by["statistical_summary"].ok
    assert not by["no_such_step"].ok
    lines = []
    for f in glob.glob(os.path.join(out, "top_customer_spending", "part-*.csv")):
        lines += open(f).read().splitlines()
    assert lines[0] == "full_name,total_spent" and len([x for x in lines if x != lines[0]]) == 5
    assert glob.glob(os.path.join(out, "step_status", "part-*.csv"))


def test_pipeline_reference_output_names(spark, scratch):
    out = os.path.join(scratch, "ref")
    statuses = run_pipeline(spark, SF, out, steps=["validation_report", "region_customer_receipts"],
                            land=False, output_names="reference")
    assert all(s.ok for s in statuses)
    assert os.path.isdir(os.path.join(out, "validation_log"))
    assert os.path.isdir(os.path.join(out, "NYCustomerReceipts"))


def test_shared_aggregates_give_identical_results(spark, scratch):
    from shelfwise.plans.params import FIXTURE
    from shelfwise.plans.pipeline import materialize_shared
    from shelfwise.plans.registry import OPERATORS, run
    from shelfwise.sources.tpch_fixture import star_from_tpch

    star = star_from_tpch(spark, SF)
    shared = materialize_shared(spark, star, os.path.join(scratch, "shared"))
    assert set(shared.aggregates) >= {"received_by_product", "shipments_per_sale", "customer_profile_full_name"}
    for name in ["receipts_vs_shipments", "full_sales_summary", "customer_spending_reg",
                 "quantity_stats", "statistical_summary", "low_stock_sales", "validate_qty_match"]:
        a = sorted(map(tuple, run(name, star).collect()), key=repr)
        b = sorted(map(tuple, run(name, shared).collect()), key=repr)
        assert a == b, name
    assert set(FIXTURE) <= set(OPERATORS)


def test_failing_shared_aggregate_fails_no_other_step(spark, scratch, monkeypatch):
    from shelfwise.operators import facts

    def broken(star):
        raise RuntimeError("no shared totals")

    monkeypatch.setattr(facts, "received_by_product", broken)
    out = os.path.join(scratch, "out")
    by = {s.step: s for s in run_pipeline(spark, SF, out, steps=["customer_sales_summary"], land=False)}
    assert not by["shared:received_by_product"].ok and by["customer_sales_summary"].ok


def test_quarantined_rows_are_written(spark, scratch):
    heads = {
        "Customers": "customer_id,first_name,last_name,address,credit_rating\n1,Sam,Lee,x,Good\n",
        "Products": "product_id,product_name,cost,selling_price,inventory_amount\n10,widget,2.0,5.0,100\n10,short\n",
        "Sales_Invoices": "sales_id,customer_id,product_id,unit_price,quantity,date\n1,1,10,5.0,3,2024-01-01\n2,1,10,5.0,x,2024-01-01\n",
        "Shipments": "shipment_id,sales_id,product_id,quantity_sold,date\n1,1,10,3,2024-01-02\n",
        "Receipts": "receipt_id,product_id,quantity_received,date\n1,10,7,2023-10-01\n",
    }
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    os.makedirs(src)
    for name, text in heads.items():
        with open(os.path.join(src, f"{name}.csv"), "w") as fh:
            fh.write(text)
    statuses = run_pipeline(spark, src, out, steps=["validate_row_counts"], quarantine=True, share=False)
    assert all(s.ok for s in statuses)
    counts = {n: spark.read.parquet(os.path.join(out, "quarantine", n)).count() for n in ("products", "sales_invoices", "receipts")}
    assert counts == {"products": 1, "sales_invoices": 1, "receipts": 0}


STEPS = ["validate_row_counts", "customer_sales_summary", "top_customer_spending", "shipment_delay_stats"]


@pytest.fixture()
def source(scratch):
    """A copy of the small tables whose files the tests may change."""
    path = os.path.join(scratch, "source")
    shutil.copytree(SF, path, ignore=shutil.ignore_patterns("doc*", "emb*", "pages*", "conv*", "bench*", "labels*"))
    return path


def _state(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs}


def _runs(spark):
    return {f for f in os.listdir(session.shared_dir(spark).removeprefix("file:")) if f.startswith("run-")}


def test_a_killed_run_goes_on_where_it_stopped(spark, scratch, source, monkeypatch):
    out, before = os.path.join(scratch, "out"), _runs(spark)

    def killed(star):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setitem(OPERATORS, "top_customer_spending", killed)
        with pytest.raises(KeyboardInterrupt):
            run_pipeline(spark, source, out, steps=STEPS)
    (run_dir,) = _runs(spark) - before  # the landed star waits for the next run
    landed = os.path.join(session.shared_dir(spark).removeprefix("file:"), run_dir, "landed_star")
    first = _state(os.path.join(out, "customer_sales_summary"))
    landed_before = _state(landed)
    seen = {}
    monkeypatch.setattr(pipeline, "_prepared", lambda *a, f=pipeline._prepared: seen.setdefault("star", f(*a)))
    monkeypatch.setattr(pipeline.Manifest, "record", lambda self, *a, f=pipeline.Manifest.record: (seen.setdefault("landed", _state(landed)), f(self, *a)))
    statuses = {s.step: s for s in run_pipeline(spark, source, out, steps=STEPS)}
    assert seen["landed"] == landed_before  # nothing was landed again
    assert all(s.ok for s in statuses.values())
    assert [statuses[s].resumed for s in STEPS] == [True, True, False, False]
    assert _state(os.path.join(out, "customer_sales_summary")) == first
    assert _runs(spark) == before  # done: the intermediates are gone
    again = run_pipeline(spark, source, out, steps=STEPS)
    assert all(s.ok and s.resumed for s in again)
    assert not any(s.resumed for s in run_pipeline(spark, source, out, steps=STEPS[:1], resume=False))


def test_a_failed_step_leaves_no_stale_output(spark, scratch, source, monkeypatch):
    out, before = os.path.join(scratch, "out"), _runs(spark)
    assert all(s.ok for s in run_pipeline(spark, source, out, steps=STEPS, share=False))
    shutil.copy(os.path.join(source, "nation.parquet"), os.path.join(source, "more.parquet"))  # another input

    def broken(star):
        return star.sales.selectExpr("raise_error('no result') AS x")

    with monkeypatch.context() as m:
        m.setitem(OPERATORS, "top_customer_spending", broken)
        by = {s.step: s for s in run_pipeline(spark, source, out, steps=STEPS, share=False)}
    assert [by[s].ok for s in STEPS] == [True, True, False, True] and not any(s.resumed for s in by.values())
    assert not os.path.exists(os.path.join(out, "top_customer_spending"))
    assert not [f for f in os.listdir(out) if f.startswith("_staged")]
    status = spark.read.option("header", True).csv(os.path.join(out, "step_status")).collect()
    assert [r["step"] for r in status if r["ok"] == "false"] == ["top_customer_spending"]
    repaired = {s.step: s for s in run_pipeline(spark, source, out, steps=STEPS, share=False)}
    assert [repaired[s].resumed for s in STEPS] == [True, True, False, True] and repaired[STEPS[2]].ok
    assert _runs(spark) == before


def test_a_run_removes_results_of_another_input_before_it_starts(spark, scratch, source, monkeypatch):
    out = os.path.join(scratch, "out")
    run_pipeline(spark, source, out, steps=STEPS[:2], share=False, fmt="csv_file")
    assert os.path.isfile(os.path.join(out, "customer_sales_summary.csv"))
    shutil.copy(os.path.join(source, "nation.parquet"), os.path.join(source, "more.parquet"))
    monkeypatch.setattr(pipeline, "_prepared", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        run_pipeline(spark, source, out, steps=STEPS[:2], share=False, fmt="csv_file")
    assert not [f for f in os.listdir(out) if f.startswith(("customer", "validate"))]


def test_other_parameters_or_formats_are_other_results(spark, scratch, source):
    out = os.path.join(scratch, "out")
    step = ["top_customer_spending"]
    run_pipeline(spark, source, out, steps=step, share=False)
    for change in ({"params": {step[0]: {"k": 2}}}, {"fmt": "csv_file"}, {"rounding": "nearest"}):
        (status,) = run_pipeline(spark, source, out, steps=step, share=False, **change)
        assert status.ok and not status.resumed
    (status,) = run_pipeline(spark, source, out, steps=step, share=False, fmt="csv_file", output_names="reference")
    with open(os.path.join(out, "TopCustomerSpending.csv")) as fh:
        assert len(fh.read().splitlines()) == 6
