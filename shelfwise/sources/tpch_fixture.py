"""Derive the retail star schema from TPC-H-style tables (the test and bench inputs).

Each logical table is a projection of the TPC-H tables; the rules are fixed so that an
independent SQL engine can rebuild the same rows (see ``shelfwise.plans.oracle_sql``).

Plan notes (target: a lineitem of hundreds of billions of rows)
* ``nation``/``region`` have a fixed size (25 and 5 rows), so they are broadcast explicitly.
* Sales_Invoices needs one row per (l_orderkey, l_linenumber). The join with ``orders`` is on
  ``l_orderkey``; grouping on (l_orderkey, l_linenumber) reuses that hash partitioning, so the
  aggregate adds no shuffle after the sort-merge join. ``sales_id = l_orderkey*10+l_linenumber``
  is one-to-one with the pair because line numbers are 1..7. The join sorts both sides, and the
  aggregate sorts once more, so its partitions are numbered by the size of the lines
  (:func:`line_partitions`): a task's sorts stay the same however large the table is.
* ``part`` is joined without a hint: Spark broadcasts it only below the size thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.files import total_bytes
from shelfwise.sources.contracts import (
    CUSTOMERS,
    PRODUCTS,
    RECEIPTS,
    SALES_INVOICES,
    SHIPMENTS,
    conform,
)
from shelfwise.sources.star import Star

# Fixed values of the fixture mapping (market segment -> credit rating; all others are "Good").
SEGMENT_RATING = {"BUILDING": "Excellent", "AUTOMOBILE": "Fair", "MACHINERY": "Poor"}
DEFAULT_RATING = "Good"
UNSOLD_EVERY = 40

#: Bytes of the lines' files (compressed): tables below the first are left to AQE, else a partition of the
#: invoice join takes the second; at most so many partitions, beyond which a task's sorts grow and spill.
SMALL_BYTES = 64 << 20
PARTITION_BYTES = 16 << 20
MOST_PARTITIONS = 20_000


def line_partitions(n_bytes: int, least: int) -> int | None:
    """Partitions of the invoice join. With fewer than ``least`` (the session's) Spark would shuffle again."""
    if n_bytes < SMALL_BYTES:
        return None
    return max(least, min(-(-n_bytes // PARTITION_BYTES), MOST_PARTITIONS))


def _line_key() -> F.Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def customers_from_tpch(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    rating = F.lit(DEFAULT_RATING)
    for segment, value in reversed(list(SEGMENT_RATING.items())):
        rating = F.when(F.col("c_mktsegment") == segment, value).otherwise(rating)
    geo = F.broadcast(
        nation.select("n_nationkey", "n_name", "n_regionkey").join(
            region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")
        )
    )
    out = customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("first_name"),
        F.right(F.col("c_name"), F.lit(3)).alias("last_name"),
        F.concat(F.col("n_name"), F.lit(", "), F.col("r_name")).alias("address"),
        rating.alias("credit_rating"),
    )
    return conform(out, CUSTOMERS)


def products_from_tpch(part: DataFrame) -> DataFrame:
    """One product per part, and for every :data:`UNSOLD_EVERY`-th part one more that no line uses."""
    markup_pct = F.lit(50) + (F.col("p_size") % 10) * 6
    extra = F.col("p_partkey") % UNSOLD_EVERY == 0
    out = part.withColumn(
        "_unsold", F.explode(F.when(extra, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    ).select(
        F.when(F.col("_unsold"), -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("product_id"),
        F.concat("p_name", F.when(F.col("_unsold"), " (unsold)").otherwise("")).alias("product_name"),
        (F.col("p_size") * 20).alias("inventory_amount"),
        F.round(F.col("p_retailprice") * markup_pct / 100, 2).alias("cost"),
        F.col("p_retailprice").alias("selling_price"),
    )
    return conform(out, PRODUCTS)


def sales_from_tpch(
    lineitem: DataFrame, orders: DataFrame, part: DataFrame, partitions: int | None = None
) -> DataFrame:
    """One invoice per (order, line number): of several lines the first by part, quantity and price.
    ``partitions``: of the join with the orders; else as many as Spark makes."""
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(
        part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")
    )
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    if partitions:
        lines, orders = lines.repartition(partitions, "l_orderkey"), orders.repartition(partitions, "o_orderkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct("l_partkey", "l_quantity", "p_retailprice", "o_orderdate", "o_custkey")
    out = joined.groupBy("l_orderkey", "l_linenumber").agg(F.min(line).alias("line"))
    out = out.select(
        _line_key().alias("sales_id"),
        F.col("line.p_retailprice").alias("unit_price"),
        F.col("line.l_quantity").cast("int").alias("quantity"),
        F.col("line.o_orderdate").cast("date").alias("date"),
        F.col("line.l_partkey").alias("product_id"),
        F.col("line.o_custkey").alias("customer_id"),
    )
    return conform(out, SALES_INVOICES)


def _event_id() -> F.Column:
    """60 bits of a digest of the line's keys: no two lines of any size of input share it by rule."""
    keys = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return F.conv(F.substring(F.md5(keys), 1, 15), 16, 10).cast("long")


def _line_events(lineitem: DataFrame, condition: F.Column, qty_name: str) -> DataFrame:
    return lineitem.filter(condition).select(
        _event_id().alias("event_id"),
        _line_key().alias("sales_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("int").alias(qty_name),
        F.col("l_partkey").alias("product_id"),
    )


def shipments_from_tpch(lineitem: DataFrame) -> DataFrame:
    out = _line_events(lineitem, F.col("l_linestatus") == "F", "quantity_sold")
    return conform(out.withColumnRenamed("event_id", "shipment_id"), SHIPMENTS)


def receipts_from_tpch(lineitem: DataFrame) -> DataFrame:
    out = _line_events(lineitem, F.col("l_returnflag") == "R", "quantity_received")
    return conform(out.withColumnRenamed("event_id", "receipt_id"), RECEIPTS)


def star_from_tpch(spark: SparkSession, sf_dir: str) -> Star:
    """Lazy star schema over ``{sf_dir}/<table>.parquet`` (no action is run)."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lineitem, part = read("lineitem"), read("part")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = line_partitions(total_bytes(spark, f"{sf_dir}/lineitem.parquet"), least)
    return Star(
        customers=customers_from_tpch(read("customer"), read("nation"), read("region")),
        products=products_from_tpch(part),
        sales=sales_from_tpch(lineitem, read("orders"), part, partitions),
        shipments=shipments_from_tpch(lineitem),
        receipts=receipts_from_tpch(lineitem),
    )
