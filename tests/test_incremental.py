"""The summary from stored state: batches in any order, replaced and killed adds, no fact read again."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from conftest import d, make_star

from shelfwise import files
from shelfwise.operators.summary import statistical_summary
from shelfwise.plans.incremental import SummaryState, statistical_summary_batches
from shelfwise.sources.star import Star

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]


def build(spark, seed=1, prices=5):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.05 else rng.choice(DAYS)
    customers = [(i, f"F{i % 4}", f"L{i % 3}", "x", ["Good", "Poor", "Fair"][i % 3]) for i in range(12)]
    products = [(p, f"P{p % 5}", 10 * p, 1.0 + p, 3.0 + p) for p in range(8)]
    sales = [(i, float(rng.randrange(1, prices + 1)), rng.choice([None, 1, 2, 3, 7]), day(), rng.randrange(9), rng.randrange(13)) for i in range(160)]
    shipments = [(i, rng.choice([None, rng.randrange(170)]), day(), rng.randrange(1, 9), rng.randrange(9)) for i in range(150)]
    receipts = [(i, rng.randrange(9), day(), rng.randrange(1, 90)) for i in range(60)]
    return make_star(spark, customers, products, sales, shipments, receipts)


def unreadable(star):
    """The same dimensions; facts that fail when a row of them is read."""
    broken = [df.selectExpr(*[f"cast(raise_error('read again') as {t}) as {c}" for c, t in df.dtypes]) for df in (star.sales, star.shipments, star.receipts)]
    return Star(star.customers, star.products, *broken)


def metrics(df):
    return {(r["analysis"], r["metric"]): r["value"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), key


PARAMS = {"min_received": 20, "digits": None}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [2, 0, 3, 1]])
def test_days_added_one_by_one_equal_a_full_run(spark, scratch, order):
    star = build(spark)
    state = SummaryState(spark, os.path.join(scratch, "state"))
    for i in order:
        state.add_day(star, DAYS[i])
    state.add(star, None, None)
    assert len(state.batches()) == 5
    want = metrics(statistical_summary(star, **PARAMS))
    assert want[("ShipmentDelayStats", "total_delayed_shipments")] > 5
    same(metrics(state.summary(unreadable(star), **PARAMS)), want)


def test_a_new_day_reads_no_earlier_fact(spark, scratch):
    star = build(spark)
    state = SummaryState(spark, os.path.join(scratch, "state"))
    state.add(star, DAYS[0], DAYS[3])
    last = [df.filter(f"date = '{DAYS[3]}'") for df in (star.sales, star.shipments, star.receipts)]
    state.add_day(Star(star.customers, star.products, *last), DAYS[3])
    state.add(star, None, None)
    same(metrics(state.summary(unreadable(star), **PARAMS)), metrics(statistical_summary(star, **PARAMS)))


def test_a_batch_can_be_replaced(spark, scratch):
    old, new = build(spark, 1), build(spark, 2, prices=9)
    state = SummaryState(spark, os.path.join(scratch, "state"))
    for day in DAYS:
        state.add_day(old, day)
    for day in (DAYS[1], DAYS[0], DAYS[3], DAYS[2]):
        state.add_day(new, day)
    dated = [df.filter("date is not null") for df in (new.sales, new.shipments, new.receipts)]
    want = metrics(statistical_summary(Star(new.customers, new.products, *dated), **PARAMS))
    same(metrics(state.summary(unreadable(new), **PARAMS)), want)
    versions = [f for f in os.listdir(os.path.join(scratch, "state", "sale_days", f"batch={DAYS[0]}_{DAYS[1]}"))]
    assert len(versions) == 1 and len(os.listdir(os.path.join(scratch, "state", "late"))) == 1


def test_a_killed_add_leaves_the_state_and_can_be_repeated(spark, scratch, monkeypatch):
    star = build(spark)
    state = SummaryState(spark, os.path.join(scratch, "state"))
    state.add(star, DAYS[0], DAYS[2])
    before = metrics(state.summary(unreadable(star), **PARAMS))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "write_text", killed)
        with pytest.raises(KeyboardInterrupt):
            state.add(star, DAYS[2], d("2024-02-01"))
    assert len(state.batches()) == 1
    same(metrics(state.summary(unreadable(star), **PARAMS)), before)
    state.add(star, DAYS[2], d("2024-02-01"))
    state.add(star, None, None)
    same(metrics(state.summary(unreadable(star), **PARAMS)), metrics(statistical_summary(star, **PARAMS)))


def test_wrong_batches_are_refused(spark, scratch):
    star = build(spark)
    state = SummaryState(spark, os.path.join(scratch, "state"))
    with pytest.raises(ValueError):
        state.summary(star)
    state.add(star, DAYS[0], DAYS[2])
    for start, end in ((DAYS[1], DAYS[3]), (DAYS[3], DAYS[3]), (DAYS[3], None)):
        with pytest.raises(ValueError):
            state.add(star, start, end)


def test_batches_make_the_invoices_once(spark, monkeypatch):
    star, seen, add = build(spark), [], SummaryState.add

    def watched(state, part, *days):
        seen.append(part.sales)
        add(state, part, *days)

    monkeypatch.setattr(SummaryState, "add", watched)
    got = metrics(statistical_summary_batches(star, cuts=["2024-01-03"], **PARAMS))
    same(got, metrics(statistical_summary(star, **PARAMS)))
    assert len(seen) == 3 and all("/invoices-" in f for sales in seen for f in sales.inputFiles())
    assert all(sales.inputFiles() for sales in seen)


def test_few_parts_are_folded_in_one_step(spark, scratch):
    star = build(spark)
    state = SummaryState(spark, os.path.join(scratch, "state"))
    for start, end in ((DAYS[0], DAYS[2]), (DAYS[2], d("2024-02-01"))):
        state.add(star, start, end)
    totals = state.star(star.customers, star.products, star).aggregates["sales_totals"]
    plan = totals._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
