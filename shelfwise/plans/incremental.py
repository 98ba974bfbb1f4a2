"""The statistical summary from stored state: a new day is added without reading earlier facts again.

Facts are added batch by batch; a batch is a range of dates, usually one day. For each batch the state
holds counts, sums and centred moments per (batch, key):

* ``sales``: invoices per customer and per product id, as
  :func:`shelfwise.operators.facts.sales_totals` makes them;
* ``shipped``: shipments per product id; ``received``: receipts per product id;
* ``sale_days``, ``ship_days``: the ids and days that late shipments are found by;
* ``late``: late shipments by (batch of the invoice, batch of the shipment, both days).

Moments merge exactly (:func:`shelfwise.functions.regression.fold_moments`), so the totals over all
batches are those of one pass over all facts, up to the order of summation. :meth:`SummaryState.star`
attaches them to a star, and :func:`shelfwise.operators.summary.statistical_summary` then reads no fact.

Batches may come in any order. A batch counts when it is entered in ``batches/``, by one small file that
is written after all its tables and names their version, so an add that is killed leaves the state
as it was and can be repeated. Adding a batch again replaces it. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import files
from shelfwise.functions import regression as ols
from shelfwise.operators import facts
from shelfwise.operators.summary import statistical_summary
from shelfwise.session import fresh_path, pinned
from shelfwise.sources.star import Star

UNDATED = "undated"
KEYED = ("sales", "shipped", "received", "sale_days", "ship_days")
#: Moment sets of the invoices (see :func:`shelfwise.operators.facts.sales_totals`).
SALES_FITS = ("_q", "_s", "_g")


def batch_name(start: dt.date | None, end: dt.date | None) -> str:
    return UNDATED if start is None else f"{start.isoformat()}_{end.isoformat()}"


class SummaryState:
    """State under ``base`` (a folder all executors reach)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _table(self, name: str, batch: str) -> str:
        return os.path.join(self.base, name, f"batch={batch}")

    def batches(self) -> dict[str, dict]:
        """The entered batches: name -> start, end, and the version of their tables."""
        entries = {}
        for entry in files.listing(self.spark, os.path.join(self.base, "batches")):
            name = os.path.basename(entry.path).removesuffix(".json")
            entries[name] = json.loads(files.read_text(self.spark, entry.path))
        return entries

    def add_day(self, star: Star, day: dt.date) -> None:
        self.add(star, day, day + dt.timedelta(days=1))

    def add(self, star: Star, start: dt.date | None, end: dt.date | None) -> None:
        """Adds the facts dated from ``start`` on and before ``end``; (None, None): those without a date.
        Of the earlier batches only the ids and days are read, to find late shipments."""
        if (start is None) != (end is None) or (start is not None and start >= end):
            raise ValueError(f"not a range of days: {start} to {end}")
        name, known = batch_name(start, end), self.batches()
        if start is not None:
            for other, entry in known.items():
                if other not in (name, UNDATED) and entry["start"] < end.isoformat() and start.isoformat() < entry["end"]:
                    raise ValueError(f"batch {name} overlaps {other}")
        version = uuid.uuid4().hex
        for table, rows in self._keyed(star, start, end).items():
            rows.write.parquet(os.path.join(self._table(table, name), version))
        others = {k: v for k, v in known.items() if k != name}
        turn = 1 + max((e["turn"] for e in known.values()), default=0)
        entry = {"start": start and start.isoformat(), "end": end and end.isoformat(), "version": version, "turn": turn}
        late = self._late(name, {**others, name: entry})
        late_path = os.path.join(self.base, "late", version)
        kept = self._late_rows(known)
        if kept is not None:
            late = kept.filter((F.col("sale_batch") != name) & (F.col("ship_batch") != name)).unionByName(late)
        # One row per pair of days: a small table, written whole (but summed up by many tasks).
        late.repartition(1).write.parquet(late_path)
        # From here on the batch counts, and the late pairs are those of the last entry.
        files.write_text(self.spark, os.path.join(self.base, "batches", f"{name}.json"), json.dumps(entry))
        self._tidy(name, known.get(name), late_path)

    def _tidy(self, name: str, replaced: dict | None, late_path: str) -> None:
        if replaced:
            for table in KEYED:
                files.remove(self.spark, os.path.join(self._table(table, name), replaced["version"]))
        for entry in {os.path.dirname(f.path) for f in files.listing(self.spark, os.path.join(self.base, "late"))}:
            if os.path.basename(entry) not in ("late", os.path.basename(late_path)):
                files.remove(self.spark, entry)

    def _keyed(self, star: Star, start: dt.date | None, end: dt.date | None) -> dict[str, DataFrame]:
        date = F.col("date")
        within = date.isNull()
        if start is not None:
            low, high = (F.lit(x.isoformat()).cast("date") for x in (start, end))
            within = (date >= low) & (date < high)
        sales, shipments, receipts = (df.filter(within) for df in (star.sales, star.shipments, star.receipts))
        part = Star(star.customers, star.products, sales, shipments, receipts)
        days = lambda df, *extra: df.filter(F.col("sales_id").isNotNull() & date.isNotNull()).select("sales_id", "date", *extra)
        return {
            "sales": facts.sales_totals(part),
            "shipped": facts.shipments_by_product(part),
            "received": facts.received_by_product(part),
            "sale_days": days(sales),
            "ship_days": days(shipments).groupBy("sales_id", "date").agg(F.count(F.lit(1)).alias("n")),
        }

    def _read(self, table: str, batches: dict[str, dict]) -> DataFrame | None:
        """A table's rows of the given batches, with their batch."""
        parts = [
            self.spark.read.parquet(os.path.join(self._table(table, name), entry["version"])).withColumn("batch", F.lit(name))
            for name, entry in sorted(batches.items())
        ]
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def _late(self, name: str, batches: dict[str, dict]) -> DataFrame:
        """(sale_batch, ship_batch, sales_date, shipment_date, n) of the late pairs that ``name`` takes part in."""
        empty = self.spark.createDataFrame(
            [], "sale_batch string, ship_batch string, sales_date date, shipment_date date, n long"
        )
        own = batches[name]
        if own["start"] is None:
            return empty
        dated = {k: v for k, v in batches.items() if v["start"] is not None}
        earlier = {k: v for k, v in dated.items() if v["start"] < own["end"]}
        later = {k: v for k, v in dated.items() if k != name and v["end"] > own["start"]}
        late = self._pairs(self._read("sale_days", earlier), self._read("ship_days", {name: own}))
        if later:
            late = late.unionByName(self._pairs(self._read("sale_days", {name: own}), self._read("ship_days", later)))
        return late

    @staticmethod
    def _pairs(sales: DataFrame, shipments: DataFrame) -> DataFrame:
        invoiced = sales.select("sales_id", F.col("date").alias("sales_date"), F.col("batch").alias("sale_batch"))
        shipped = shipments.select("sales_id", F.col("date").alias("shipment_date"), F.col("batch").alias("ship_batch"), "n")
        late = shipped.join(invoiced, "sales_id").filter(F.col("shipment_date") > F.col("sales_date"))
        return late.groupBy("sale_batch", "ship_batch", "sales_date", "shipment_date").agg(F.sum("n").alias("n"))

    def _late_rows(self, batches: dict[str, dict]) -> DataFrame | None:
        """The late pairs as the last entered batch left them."""
        if not batches:
            return None
        last = max(batches.values(), key=lambda e: e["turn"])
        return self.spark.read.parquet(os.path.join(self.base, "late", last["version"]))

    def star(self, customers: DataFrame, products: DataFrame, empty: Star) -> Star:
        """A star with the dimensions given and the state's totals in place of the facts. ``empty``: a star
        whose facts give the session and the columns; their rows are not read."""
        batches = self.batches()
        if not batches:
            raise ValueError(f"no batches under {self.base}")

        # A key has a row per batch at most.
        salts = None if len(batches) <= ols.SALTS else ols.SALTS

        def folded(table: str, by: list[str], prefixes: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
            return ols.fold_moments(self._read(table, batches), by, "batch", prefixes, sums, salts)

        totals = folded("sales", ["per", "customer_id", "product_id"], SALES_FITS, ("_rows", "value", "units"))
        late = self._late_rows(batches).groupBy("sales_date", "shipment_date").agg(F.sum("n").alias("n"))
        received = self._read("received", batches).groupBy("product_id").agg(F.sum("total_received").alias("total_received"))
        star = Star(customers, products, empty.sales, empty.shipments, empty.receipts)
        return star.with_aggregates(
            sales_totals=totals,
            shipments_by_product=folded("shipped", ["product_id"], ("_t",), ("total_sold",)),
            received_by_product=received,
            late_shipments=late,
        )

    def summary(self, star: Star, **params) -> DataFrame:
        """:func:`statistical_summary` of all that was added. Only the dimensions of ``star`` are read."""
        totals = self.star(star.customers, star.products, star)
        read_often = {name: pinned(df, name) for name, df in totals.aggregates.items()}
        return statistical_summary(totals.with_aggregates(**read_often), **params)


def statistical_summary_batches(star: Star, cuts: Sequence[str] = (), **params) -> DataFrame:
    """The summary by way of a new state in the shared folder, filled in batches between the ``cuts`` (and
    before the first, after the last, and of rows without a date).

    The invoices are written first: every batch reads them twice, and whatever makes them (a join of the
    lines with their orders, say) runs once, not for each read."""
    spark = star.sales.sparkSession
    star = replace(star, sales=pinned(star.sales, "invoices"))
    state = SummaryState(spark, fresh_path(spark, "summary-state"))
    edges = [dt.date(1, 1, 1), *sorted(map(dt.date.fromisoformat, cuts)), dt.date(9999, 12, 31)]
    for start, end in zip(edges, edges[1:]):
        state.add(star, start, end)
    state.add(star, None, None)
    return state.summary(star, **params)
