"""The five-table star schema handed to every operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame

TABLE_NAMES = ("customers", "products", "sales_invoices", "shipments", "receipts")


@dataclass(frozen=True)
class Star:
    """Customers and Products (dimensions); Sales_Invoices, Shipments, Receipts (facts).

    Columns follow :mod:`shelfwise.sources.contracts`. The DataFrames are lazy; operators
    project only the columns they need, so Parquet scans read just those.

    ``aggregates`` optionally carries materialised shared aggregates (per-product totals,
    per-sale shipment counts, per-customer profiles) by name; operators use one when present
    instead of re-reading the facts (see :func:`shelfwise.plans.pipeline.materialize_shared`).

    ``sale_parts`` optionally splits invoices and shipments by sale: pairs (invoices, shipments) that
    share no ``sales_id`` and together are ``sales`` and ``shipments``. A co-bucketed landing keeps its
    hot sales apart in this way (see :mod:`shelfwise.sources.landing`).
    """

    customers: DataFrame
    products: DataFrame
    sales: DataFrame
    shipments: DataFrame
    receipts: DataFrame
    aggregates: dict[str, DataFrame] = field(default_factory=dict, compare=False)
    sale_parts: tuple[tuple[DataFrame, DataFrame], ...] = field(default=(), compare=False)

    def by_sale(self, build: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``build(invoices, shipments)`` for whatever matches the two by ``sales_id``: part by part, so a
        bucketed part stays free of shuffles and a hot one is dealt out, and the results stacked."""
        parts = self.sale_parts or ((self.sales, self.shipments),)
        return reduce(DataFrame.unionByName, [build(sales, ships) for sales, ships in parts])

    def tables(self) -> dict[str, DataFrame]:
        """Contract name -> DataFrame, in the contract's order."""
        return dict(
            zip(TABLE_NAMES, (self.customers, self.products, self.sales, self.shipments, self.receipts))
        )

    def with_aggregates(self, **aggregates: DataFrame) -> Star:
        return replace(self, aggregates={**self.aggregates, **aggregates})

    def shared(self, name: str, build) -> DataFrame:
        """The materialised aggregate ``name`` if attached, else ``build()`` (lazy)."""
        df = self.aggregates.get(name)
        return df if df is not None else build()
