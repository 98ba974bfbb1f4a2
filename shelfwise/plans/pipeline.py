"""The batch job: load -> land -> validate -> reports -> statistics -> summary.

Each step is isolated: a failing step is recorded and the run continues, as in the reference.
Because Spark is lazy, the *write* of each step sits inside its own try block -- that is where
a step's errors surface.

Landing the star schema under the shared checkpoint folder first means every later step reads
compact Parquet, and a lost executor costs a re-read of landed files rather than a re-derivation.

Restart. A run is identified by its inputs (every file's path, size and time) and settings, a step by
the run, its parameters and its output. When a step's output has been published, a manifest with
that identity is written to ``out_dir/_manifest``. A run first removes every output it is to write whose
manifest is another's, so no result of an earlier run can pass for a current one; then it
skips the steps whose manifest is its own and does the others. A killed run therefore goes on where
it stopped; the landed star and the shared aggregates are found again by the run's identity. They are
removed when all steps are done. Two runs over the same inputs must not share an output folder or
run at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import files
from shelfwise.operators import facts
from shelfwise.operators.reports import REPORTS
from shelfwise.operators.stats import STATS, customer_profile
from shelfwise.plans.registry import OPERATORS
from shelfwise.session import intermediates, shared_dir
from shelfwise.sinks import write_result
from shelfwise.sources.landing import land_star, source_bytes
from shelfwise.sources.readers import find_layout, load_star, read_csv_star, read_landed_star
from shelfwise.sources.star import Star

# Step order of a full run (validation, then the reports, then the analyses, then the summary).
DEFAULT_STEPS = ["validation_report", *REPORTS, *STATS, "statistical_summary"]

# Output names of the reference's runs, per step key (fixed values). Steps without an entry
# keep their key as the output name.
REFERENCE_OUTPUT_NAMES = {
    "validation_report": "validation_log",
    "customer_sales_summary": "CustomerSalesSummary",
    "product_shipment_totals": "ProductShipmentTotals",
    "matched_sales_shipments": "MatchedSalesShipments",
    "good_credit_purchases": "GoodCreditPurchases",
    "recent_receipts": "RecentReceipts",
    "customer_shipments": "CustomerShipments",
    "low_inventory_sales": "LowInventorySales",
    "region_customer_receipts": "NYCustomerReceipts",
    "unshipped_sales": "UnshippedSales",
    "profitable_products": "ProfitableProducts",
    "customer_purchase_patterns": "CustomerPurchasePatterns",
    "receipts_vs_shipments": "ReceiptsVsShipments",
    "top_customer_spending": "TopCustomerSpending",
    "sales_with_receipts": "SalesWithReceipts",
    "shipments_by_credit": "ShipmentsByCredit",
    "unsold_products": "UnsoldProducts",
    "shipment_delays": "ShipmentDelays",
    "high_value_receipts": "HighValueReceipts",
    "low_stock_sales": "LowStockSales",
    "full_sales_summary": "FullSalesSummary",
    "customer_purchase_stats": "CustomerPurchaseStats",
    "product_profit_margins": "ProductProfitMargins",
    "shipment_delay_stats": "ShipmentDelayStats",
    "receipt_sales_diff": "ReceiptSalesDiff_Summary",
    "receipt_sales_ttest": "ReceiptSalesDiff_ttest",
    "customer_spending_reg": "CustomerSpendingReg",
    "inventory_turnover_stats": "InventoryTurnoverStats",
    "credit_rating_summaries": "CreditRatingSummaries",
    "high_volume_reg": "HighVolumeReg",
    "customer_sales_growth": "CustomerSalesGrowth",
    "quantity_stats": "QuantityStats",
    "statistical_summary": "statistical_summary",
}


@dataclass
class StepStatus:
    step: str
    ok: bool
    seconds: float
    error: str | None = None
    #: Done by an earlier run over the same inputs, and left as it is.
    resumed: bool = False


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, default=repr, sort_keys=True).encode()).hexdigest()


def run_identity(spark: SparkSession, source: str, **settings) -> str:
    """Identity of a run: the input files (path, size, time) and what bears on every step."""
    files_ = hashlib.sha256()
    for entry in files.listing(spark, source):
        files_.update(f"{entry.path}\0{entry.length}\0{entry.modified}\n".encode())
    return _digest(files_.hexdigest(), settings)


class Manifest:
    """Which outputs under ``out_dir`` are current: one small file per output, written after it."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir = spark, out_dir

    def _path(self, name: str) -> str:
        return os.path.join(self.out_dir, "_manifest", f"{name}.json")

    def entry(self, name: str) -> dict | None:
        text = files.read_text(self.spark, self._path(name))
        return None if text is None else json.loads(text)

    def is_current(self, name: str, identity: str) -> bool:
        entry = self.entry(name)
        return bool(entry) and entry["identity"] == identity and files.exists(self.spark, entry["path"])

    def record(self, name: str, identity: str, path: str) -> None:
        entry = {"identity": identity, "path": path, "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        files.write_text(self.spark, self._path(name), json.dumps(entry))

    def forget(self, name: str) -> None:
        """Removes an output in whatever form it was written, the manifest first."""
        files.remove(self.spark, self._path(name))
        for path in (os.path.join(self.out_dir, name), os.path.join(self.out_dir, f"{name}.csv")):
            files.remove(self.spark, path)


def materialize_shared(
    spark: SparkSession,
    star: Star,
    base: str,
    customer_key: str = "full_name",
    failed: list[StepStatus] | None = None,
) -> Star:
    """Write the aggregates most steps share once, under ``base``, and attach them to the star.

    Per-customer and per-product sales totals (one scan), per-product received and shipped units,
    per-sale shipment counts and the per-customer profile feed about twenty steps. They are small
    next to the facts (one row per product, sale or customer) and live in the shared checkpoint
    folder, so a lost executor re-reads them rather than recomputing. One that is complete under ``base``
    already, from a run that was stopped, is used as it is.

    With ``failed``, an aggregate that fails is recorded there and left out: the steps that use it
    then build it themselves, and only they can fail by it.
    """
    builders = {
        "received_by_product": facts.received_by_product,
        "sales_totals": facts.sales_totals,
        "shipments_by_product": facts.shipments_by_product,
        "shipments_per_sale": facts.shipments_per_sale,
        f"customer_profile_{customer_key}": lambda star: customer_profile(star, customer_key),
    }
    for name, build in builders.items():
        path, t0 = os.path.join(base, name), time.perf_counter()
        try:
            if not files.exists(spark, os.path.join(path, "_SUCCESS")):
                build(star).write.mode("overwrite").parquet(path)
            star = star.with_aggregates(**{name: spark.read.parquet(path)})
        except Exception as exc:  # noqa: BLE001 - as for a step
            if failed is None:
                raise
            failed.append(StepStatus(f"shared:{name}", False, time.perf_counter() - t0, str(exc)[:500]))
    return star


def run_pipeline(
    spark: SparkSession,
    source: str,
    out_dir: str,
    steps: list[str] | None = None,
    land: bool = True,
    fmt: str = "csv",
    params: dict[str, dict] | None = None,
    buckets: int | None = None,
    output_names: str = "keys",
    share: bool = True,
    layout: str | None = None,
    quarantine: bool = False,
    rounding: str | None = None,
    resume: bool = True,
    keep_intermediates: bool = False,
) -> list[StepStatus]:
    """Run ``steps`` (default: all) over the star schema at ``source``; write each result to
    ``out_dir/<step>`` and a ``step_status`` table. Returns the per-step status list.

    Operators run with their own defaults (the reference's literals) unless ``params`` maps a
    step name to keyword overrides, e.g. ``{"recent_receipts": {"after": "2001-06-01"}}``.
    ``buckets`` lands Sales_Invoices and Shipments co-bucketed on ``sales_id`` (see
    :mod:`shelfwise.sources.landing`), removing the fact-fact shuffles of later steps.
    ``output_names="reference"`` writes each result under the reference's output name
    (:data:`REFERENCE_OUTPUT_NAMES`) instead of the step key. ``share`` materialises the
    aggregates most steps have in common first (:func:`materialize_shared`). ``layout`` names the
    source's layout instead of looking for it; a source that is landed already is not landed again.
    ``quarantine`` (CSV drop) writes malformed rows to ``out_dir/quarantine/<table>`` and goes on
    with the others; without it they abort the run. ``fmt="csv_file"`` writes one CSV file per result.
    ``rounding``: a mode of :func:`shelfwise.functions.rounding.round_value`; by default ``nearest`` (R's)
    under the reference's names and ``half_up`` else. ``resume=False`` does every step anew.

    A step that fails leaves no output behind, neither its own nor an earlier run's.
    """
    if output_names not in ("keys", "reference"):
        raise ValueError(f"output_names must be 'keys' or 'reference', got {output_names!r}")
    rounding = rounding or ("nearest" if output_names == "reference" else "half_up")
    layout = layout or find_layout(spark, source)
    if quarantine and layout != "csv":
        raise ValueError(f"quarantine is for the CSV drop; {source!r} is {layout}")
    identity = run_identity(spark, source, layout=layout, land=land, buckets=buckets, share=share, quarantine=quarantine)
    run_dir = os.path.join(shared_dir(spark), f"run-{identity[:24]}")
    manifest = Manifest(spark, out_dir)
    names, identities = {}, {}
    for step in steps or DEFAULT_STEPS:
        names[step] = REFERENCE_OUTPUT_NAMES.get(step, step) if output_names == "reference" else step
        identities[step] = _digest(identity, step, (params or {}).get(step, {}), fmt, names[step], rounding)
        if not resume or not manifest.is_current(names[step], identities[step]):
            manifest.forget(names[step])
    if not resume:
        files.remove(spark, run_dir)
    statuses: list[StepStatus] = []
    todo = [step for step in names if step in OPERATORS and not manifest.is_current(names[step], identities[step])]
    with intermediates(spark):
        star = _prepared(spark, source, layout, run_dir, out_dir, land, buckets, share, quarantine, statuses) if todo else None
        for step, name in names.items():
            if step not in OPERATORS:
                statuses.append(StepStatus(step, False, 0.0, "unknown step"))
                continue
            if step not in todo:
                statuses.append(StepStatus(step, True, 0.0, resumed=True))
                continue
            t0 = time.perf_counter()
            try:
                df = OPERATORS[step](star, **(params or {}).get(step, {}))
                if step == "validation_report":
                    df = df.withColumn("run_ts", F.current_timestamp())  # the validation log's run time
                path = write_result(df, out_dir, name, fmt=fmt, mode=rounding)
                manifest.record(name, identities[step], path)
                statuses.append(StepStatus(step, True, time.perf_counter() - t0))
            except Exception as exc:  # noqa: BLE001 - a failed step must not stop the run
                statuses.append(StepStatus(step, False, time.perf_counter() - t0, str(exc)[:500]))
    # One row per step: a bounded table, written as a single file.
    write_result(status_df(spark, statuses).coalesce(1), out_dir, "step_status", digits=None)
    if not keep_intermediates and all(s.ok for s in statuses):
        files.remove(spark, run_dir)
    return statuses


def _prepared(
    spark: SparkSession,
    source: str,
    layout: str,
    run_dir: str,
    out_dir: str,
    land: bool,
    buckets: int | None,
    share: bool,
    quarantine: bool,
    statuses: list[StepStatus],
) -> Star:
    """The star the steps read: landed and with shared aggregates, as far as that is not there already."""
    base = os.path.join(run_dir, "landed_star")
    complete = os.path.join(base, "_complete")
    if files.exists(spark, complete):
        star = read_landed_star(spark, base)
    else:
        if quarantine:
            star, bad = read_csv_star(spark, source, mode="quarantine")
            for name, rows in bad.items():
                write_result(rows, os.path.join(out_dir, "quarantine"), name, fmt="parquet", digits=None)
        else:
            star = load_star(spark, source, layout)
        if land and layout != "landed":
            files.remove(spark, base)
            star = land_star(spark, star, base, buckets=buckets, n_bytes=source_bytes(spark, source))
            files.write_text(spark, complete, "")
    if share:
        star = materialize_shared(spark, star, os.path.join(run_dir, "shared"), failed=statuses)
    return star


def status_df(spark: SparkSession, statuses: list[StepStatus]) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("step", T.StringType()),
            T.StructField("ok", T.BooleanType()),
            T.StructField("seconds", T.DoubleType()),
            T.StructField("error", T.StringType()),
            T.StructField("resumed", T.BooleanType()),
        ]
    )
    return spark.createDataFrame([(s.step, s.ok, s.seconds, s.error, s.resumed) for s in statuses], schema)


def main(argv: list[str] | None = None) -> int:
    """``python -m shelfwise.plans.pipeline SOURCE OUT [--buckets N] [--reference-names]``
    (or ``spark-submit --py-files shelfwise.zip shelfwise/plans/pipeline.py ...``)."""
    import argparse

    from shelfwise.session import build_session

    ap = argparse.ArgumentParser(description="Run the retail analytics batch job.")
    ap.add_argument("source", help="landed star, CSV drop, or TPC-H tables")
    ap.add_argument("out", help="output folder (one sub-folder per step)")
    ap.add_argument("--steps", nargs="*", help="subset of steps (default: all)")
    ap.add_argument("--buckets", type=int, default=None, help="co-bucket invoices and shipments")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet", "csv_file"])
    ap.add_argument("--reference-names", action="store_true", help="reference output names")
    ap.add_argument("--quarantine", action="store_true", help="write malformed CSV rows aside and go on")
    ap.add_argument("--rounding", choices=["half_up", "half_even", "nearest"], help="rounding of results")
    ap.add_argument("--no-resume", action="store_true", help="do every step anew")
    ap.add_argument("--no-land", action="store_true", help="read the source directly")
    args = ap.parse_args(argv)
    spark = build_session()
    statuses = run_pipeline(
        spark,
        args.source,
        args.out,
        steps=args.steps,
        land=not args.no_land,
        fmt=args.format,
        buckets=args.buckets,
        output_names="reference" if args.reference_names else "keys",
        quarantine=args.quarantine,
        rounding=args.rounding,
        resume=not args.no_resume,
    )
    failed = [s.step for s in statuses if not s.ok]
    resumed = sum(s.resumed for s in statuses)
    print(f"{len(statuses) - len(failed)} steps ok ({resumed} done before), failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
