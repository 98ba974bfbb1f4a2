"""Readers for the star schema: header CSV, Parquet, landed tables, TPC-H fixture.

``load_star(spark, path)`` resolves what ``path`` holds:

* a landed star schema (``customers/``, ``products/``, ``sales_invoices/``, ``shipments/``,
  ``receipts/`` Parquet folders, as written by :func:`shelfwise.sources.landing.land_star`);
* the reference's CSV drop (``Customers.csv`` ... ``Receipts.csv``), read **by header name**;
* TPC-H-style tables (``lineitem.parquet`` ...), mapped by :mod:`shelfwise.sources.tpch_fixture`.
"""

from __future__ import annotations

import csv
import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.files import exists, first_lines, listing, total_bytes
from shelfwise.sources.contracts import CONTRACTS, ContractError, conform, quarantine
from shelfwise.sources.star import Star
from shelfwise.sources.tpch_fixture import star_from_tpch

# File names of the reference's CSV drop, per contract name (fixed values).
CSV_FILES = {
    "customers": "Customers.csv",
    "products": "Products.csv",
    "sales_invoices": "Sales_Invoices.csv",
    "shipments": "Shipments.csv",
    "receipts": "Receipts.csv",
}


#: Prefix of the folders that hold the hot sales of a co-bucketed landing.
HOT = "hot_"
#: Hot sales' invoices up to this size on disk are broadcast to their shipments; beyond it Spark joins
#: them as any other table.
HOT_INVOICE_BYTES = 8 << 20

#: Holds the raw line of a row whose number of fields is not the header's.
CORRUPT = "_corrupt_record"


def header_census(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a CSV file or folder by their header. Empty files have none and are left out."""
    lines = first_lines(spark, [f.path for f in listing(spark, path)])
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in lines.items():
        if line is not None:
            names = tuple(name.strip() for name in next(csv.reader([line.removeprefix("\ufeff")]), []))
            groups.setdefault(names, []).append(file)
    return groups


def _missing(names: tuple[str, ...], contract: T.StructType) -> list[str]:
    """Contract columns that a header lacks or names more than once."""
    have = [n.lower() for n in names]
    return [f.name for f in contract.fields if have.count(f.name.lower()) != 1]


def read_csv_table(
    spark: SparkSession,
    path: str,
    contract: T.StructType,
    mode: str = "strict",
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read a header CSV (file or folder) and map its columns to ``contract`` **by header name**.

    Part files may have their columns in different orders and may have more columns than the contract:
    the files are grouped by header, each group is read by its own, and the groups are united by name.
    Every field is read as a string (no inference pass over the data), then cast.

    ``mode='strict'``: a file without a contract column, a row with too few or too many fields, or a
    value that does not parse, aborts the job. ``mode='quarantine'``: returns ``(good_rows, bad_rows)``;
    bad rows keep their raw strings, and the whole line in ``_corrupt_record`` where the field count is
    wrong. All rows of a file without a contract column are bad.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    groups = header_census(spark, path)
    if not groups:
        if not exists(spark, path):
            spark.read.csv(path)  # Spark's own error names the path
        groups = {tuple(contract.names): []}
    lacking = {names: files for names, files in groups.items() if _missing(names, contract)}
    if mode == "strict" and lacking:
        names, files = next(iter(lacking.items()))
        raise ContractError(f"missing columns {_missing(names, contract)} in {files[0]}; its header is {list(names)}")
    reader = spark.read.option("header", True).option("enforceSchema", False).option("columnPruning", False)
    good, bad = [], []
    for names, files in groups.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        if not files:
            good.append(conform(spark.createDataFrame([], schema), contract))
        elif mode == "strict":
            good.append(conform(reader.schema(schema).option("mode", "FAILFAST").csv(files), contract, strict=True))
        elif names in lacking:
            # Named by place: a header may repeat a name.
            places = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
            raw = spark.read.option("header", True).schema(places.add(CORRUPT, T.StringType()))
            bad.append(raw.option("columnNameOfCorruptRecord", CORRUPT).csv(files))
        else:
            raw = reader.schema(schema.add(CORRUPT, T.StringType())).option("mode", "PERMISSIVE")
            rows = quarantine(raw.option("columnNameOfCorruptRecord", CORRUPT).csv(files), contract, corrupt=CORRUPT)
            good.append(rows[0])
            bad.append(rows[1])
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if mode == "strict":
        return union(good)
    empty = spark.createDataFrame([], contract)
    return union(good or [empty]), union(bad or [empty])


def read_parquet_table(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """Parquet table conformed by name; casts are no-ops when the types already match."""
    return conform(spark.read.parquet(path), contract)


def read_csv_star(
    spark: SparkSession, csv_dir: str, mode: str = "strict"
) -> Star | tuple[Star, dict[str, DataFrame]]:
    """The CSV drop as a star; ``mode='quarantine'`` returns the bad rows per table with it."""
    tables = {
        name: read_csv_table(spark, os.path.join(csv_dir, CSV_FILES[name]), CONTRACTS[name], mode)
        for name in CONTRACTS
    }
    if mode == "strict":
        return Star(*(tables[name] for name in CONTRACTS))
    good = Star(*(tables[name][0] for name in CONTRACTS))
    return good, {name: pair[1] for name, pair in tables.items()}


def read_landed_star(spark: SparkSession, base: str) -> Star:
    """Landed Parquet folders; a fact registered in the catalog as a bucketed table for this
    location is read through the catalog, so its bucketing is visible to the planner. Hot sales landed
    beside the buckets become a part of their own (``Star.sale_parts``)."""
    from shelfwise.sources.landing import bucketed_table_name  # landing imports this module

    tables = {}
    for name in CONTRACTS:
        table = bucketed_table_name(base, name)
        if spark.catalog.tableExists(table):
            tables[name] = conform(spark.table(table), CONTRACTS[name])
        else:
            tables[name] = read_parquet_table(spark, os.path.join(base, name), CONTRACTS[name])
    parts = ()
    hot = {name: os.path.join(base, HOT + name) for name in ("sales_invoices", "shipments")}
    if all(_exists(spark, "parquet", path) for path in hot.values()):
        cold = tables["sales_invoices"], tables["shipments"]
        apart = tuple(read_parquet_table(spark, path, CONTRACTS[name]) for name, path in hot.items())
        few = total_bytes(spark, hot["sales_invoices"]) <= HOT_INVOICE_BYTES
        parts = (cold, (F.broadcast(apart[0]) if few else apart[0], apart[1]))
        tables["sales_invoices"], tables["shipments"] = (c.unionByName(h) for c, h in zip(cold, apart))
    return Star(*(tables[name] for name in CONTRACTS), sale_parts=parts)


def _exists(spark: SparkSession, reader: str, path: str) -> bool:
    """Whether Spark finds ``path`` (in its default file system if it has no scheme). Any other
    failure, such as a missing permission, is the caller's to see."""
    try:
        getattr(spark.read.option("header", True), reader)(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


LAYOUTS = ("landed", "csv", "tpch")


def find_layout(spark: SparkSession, path: str) -> str:
    """Which of :data:`LAYOUTS` lies at ``path`` (a file listing and a footer or header at most)."""
    if _exists(spark, "parquet", os.path.join(path, "sales_invoices")):
        return "landed"
    if _exists(spark, "csv", os.path.join(path, CSV_FILES["sales_invoices"])):
        return "csv"
    return "tpch"


def load_star(spark: SparkSession, path: str, layout: str | None = None) -> Star:
    """Resolve ``path`` to a :class:`Star` (see module docstring). Lazy: no job over data is run.
    ``layout`` names the layout instead of looking for it."""
    layout = layout or find_layout(spark, path)
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, got {layout!r}")
    if layout == "landed":
        return read_landed_star(spark, path)
    return read_csv_star(spark, path) if layout == "csv" else star_from_tpch(spark, path)
