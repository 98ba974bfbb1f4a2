"""Land a star schema as Parquet in a shared folder (the load step).

Landing cuts the lineage of derived sources, so later reports read compact columnar files,
and a lost executor costs only a re-read, never a recomputation of the derivation.

Layout
* Facts are range-partitioned on (date, id) before writing: each file covers a narrow date
  span, so Parquet min/max statistics let ``date`` filters skip row groups, and a hot day is
  split across several files because the id continues the range key.
* The number of files follows the size of the source (``FILE_BYTES`` each), not a session default.
* With ``buckets=N``, Sales_Invoices and Shipments are instead written as catalog tables
  bucketed and sorted by ``sales_id`` into the same N buckets, one file per bucket. Every
  invoice-shipment join and every per-sale aggregate then reads co-partitioned data: no shuffle of
  either fact table. N should give bucket files of a few hundred MB at the target size.
* A bucket is read by one task and cannot be split, so sales that hold more than ``HOT_SHARE`` times
  a bucket's fair share of the shipments are kept out of the buckets. A heavy-hitter sketch over the
  shipments names the candidates, a count confirms them (there are fewer than ``buckets`` / ``HOT_SHARE``),
  and their invoices and shipments are landed beside the buckets in the plain layout. Operators match
  invoices to shipments part by part (``Star.by_sale``): the few invoices of hot sales are replicated to
  every file of their shipments (by broadcast, behind a check of their size), so no task gets a hot
  sale whole.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.files import remove, total_bytes
from shelfwise.sources.readers import HOT, read_landed_star
from shelfwise.sources.star import Star

FACT_IDS = {"sales_invoices": "sales_id", "shipments": "shipment_id", "receipts": "receipt_id"}
CO_BUCKETED = ("sales_invoices", "shipments")


def land_table(df: DataFrame, path: str, partitions: int | None = None, cluster: bool = True) -> None:
    """Overwrite ``path`` with ``df``; facts are range-clustered on (date, id) first, into
    ``partitions`` files or as many as AQE makes of the data's size."""
    if cluster:
        keys = _cluster_keys(df)
        df = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    df.write.mode("overwrite").parquet(path)


def _cluster_keys(df: DataFrame) -> list[str]:
    keys = ["date"] if "date" in df.columns else []
    for id_col in ("sales_id", "shipment_id", "receipt_id", "product_id", "customer_id"):
        if id_col in df.columns:
            keys.append(id_col)
            break
    return keys


def bucketed_table_name(base: str, name: str) -> str:
    """Catalog name of a bucketed fact landed under ``base`` (stable per location)."""
    return f"shelfwise_{hashlib.sha1(base.encode()).hexdigest()[:12]}_{name}"


def land_bucketed(df: DataFrame, base: str, name: str, buckets: int) -> None:
    (
        df.repartition(buckets, "sales_id")  # one task, so one file, per bucket
        .write.mode("overwrite")
        .bucketBy(buckets, "sales_id")
        .sortBy("sales_id")
        .option("path", os.path.join(base, name))
        .saveAsTable(bucketed_table_name(base, name))
    )


FILE_BYTES = 256 << 20
HOT_SHARE = 4.0


def source_bytes(spark: SparkSession, path: str) -> int:
    return total_bytes(spark, path)


def partitions_for(n_bytes: int) -> int:
    return max(1, -(-n_bytes // FILE_BYTES))


def hot_sales(shipments: DataFrame, buckets: int) -> list[int]:
    """Ids of the sales with more than ``HOT_SHARE`` times the mean bucket's shipments.

    The sketch's error is a few parts in its size, an eighth of the limit at most; what it names is counted
    exactly. Both passes read one column and shuffle one row per task and candidate.
    """
    size = min(max(1000, 32 * buckets), 1_000_000)
    ids = shipments.select("sales_id")
    total, top = ids.agg(F.count("sales_id"), F.expr(f"approx_top_k(sales_id, {min(buckets, size)}, {size})")).first()
    limit = max(1, HOT_SHARE * total / buckets)
    likely = [x["item"] for x in top or () if x["item"] is not None and x["count"] > limit]
    if not likely:
        return []
    counted = ids.filter(F.col("sales_id").isin(likely)).groupBy("sales_id").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["sales_id"] for r in counted.filter(F.col("n") > limit).collect())


def land_star(
    spark: SparkSession,
    star: Star,
    base: str,
    fact_partitions: int | None = None,
    buckets: int | None = None,
    n_bytes: int | None = None,
) -> Star:
    """Write the five tables under ``base`` and return a :class:`Star` reading them back.

    ``fact_partitions``: files per fact; else from ``n_bytes`` (size of the source), else left to
    AQE. ``buckets`` turns on the co-bucketed layout of Sales_Invoices and Shipments (needs a
    session catalog); hot sales lie beside it. What an earlier bucketed landing left at ``base`` is
    dropped first.
    """
    n = fact_partitions or (partitions_for(n_bytes) if n_bytes is not None else None)
    hot = hot_sales(star.shipments, buckets) if buckets else []
    is_hot = F.coalesce(F.col("sales_id").isin(hot), F.lit(False))
    for name in CO_BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {bucketed_table_name(base, name)}")
        remove(spark, os.path.join(base, HOT + name))
    for name, df in star.tables().items():
        if buckets and name in CO_BUCKETED:
            land_bucketed(df.filter(~is_hot) if hot else df, base, name, buckets)
            if hot:
                land_table(df.filter(is_hot), os.path.join(base, HOT + name), n)
        else:
            land_table(df, os.path.join(base, name), n, cluster=name in FACT_IDS)
    return read_landed_star(spark, base)
