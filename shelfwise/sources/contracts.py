"""Typed contracts of the five star-schema tables and the by-name conform step.

Identifiers are ``LongType`` throughout: at the target scale customer and product keys exceed
the 32-bit range. Columns are always mapped **by name**, never by position, so a source whose
column order differs from the contract cannot shift values into the wrong columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("credit_rating", T.StringType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("inventory_amount", T.IntegerType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("selling_price", T.DoubleType()),
    ]
)

SALES_INVOICES = T.StructType(
    [
        T.StructField("sales_id", T.LongType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
    ]
)

SHIPMENTS = T.StructType(
    [
        T.StructField("shipment_id", T.LongType()),
        T.StructField("sales_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("quantity_sold", T.IntegerType()),
        T.StructField("product_id", T.LongType()),
    ]
)

RECEIPTS = T.StructType(
    [
        T.StructField("receipt_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("quantity_received", T.IntegerType()),
    ]
)

# Logical table name -> contract. The names double as folder names of a landed star schema.
CONTRACTS: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "sales_invoices": SALES_INVOICES,
    "shipments": SHIPMENTS,
    "receipts": RECEIPTS,
}


class ContractError(ValueError):
    """A source lacks a column the contract requires."""


def _cast(col: Column, dtype: T.DataType, strict: bool) -> Column:
    return col.cast(dtype) if strict else col.try_cast(dtype)


def conform(df: DataFrame, contract: T.StructType, strict: bool = True) -> DataFrame:
    """Select the contract's columns **by name** (case-insensitive) and cast them.

    ``strict=True`` uses ANSI casts: a value that does not parse aborts the job, as the
    reference's typed insert does. ``strict=False`` uses ``try_cast`` (unparseable -> NULL);
    pair it with :func:`quarantine` to keep the bad rows instead of losing them silently.
    """
    by_lower = {c.lower(): c for c in df.columns}
    missing = [f.name for f in contract.fields if f.name.lower() not in by_lower]
    if missing:
        raise ContractError(f"missing columns {missing}; source has {df.columns}")
    return df.select(
        *[
            _cast(F.col(f"`{by_lower[f.name.lower()]}`"), f.dataType, strict).alias(f.name)
            for f in contract.fields
        ]
    )


def quarantine(
    df: DataFrame, contract: T.StructType, corrupt: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split a raw (string-typed) source into (conforming rows, bad rows).

    A row is bad when some field is non-NULL in the source but NULL after ``try_cast``, or when
    the reader marked it in the column ``corrupt``. Both outputs are lazy and computed from one
    scan each; nothing is dropped.
    """
    by_lower = {c.lower(): c for c in df.columns}
    failed = F.lit(False) if corrupt is None else F.col(corrupt).isNotNull()
    for field in contract.fields:
        if field.name.lower() in by_lower:
            value = F.col(f"`{by_lower[field.name.lower()]}`")
            failed = failed | (value.isNotNull() & value.try_cast(field.dataType).isNull())
    flagged = df.withColumn("_cast_failed", failed)
    good = conform(flagged.filter(~F.col("_cast_failed")), contract, strict=False)
    bad = flagged.filter(F.col("_cast_failed")).drop("_cast_failed")
    return good, bad


def schema_matches(df: DataFrame, contract: T.StructType) -> bool:
    """True when every contract field is present by name with the contract's type."""
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    return all(have.get(f.name.lower()) == f.dataType for f in contract.fields)
