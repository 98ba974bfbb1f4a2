"""Result sinks: rounded, distributed writes. A result is a folder of part files, or one CSV file."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from shelfwise.files import join_files, listing, publish, remove
from shelfwise.functions.rounding import round_numeric

FORMATS = ("csv", "parquet", "csv_file")


def write_result(
    df: DataFrame,
    base: str,
    name: str,
    fmt: str = "csv",
    digits: int | None = 2,
    mode: str = "half_up",
) -> str:
    """Round fractional columns and replace ``{base}/{name}``; returns the path.

    Executors write their partitions in parallel; nothing is funnelled through one task
    (no ``coalesce(1)``). CSV gets a header and ``NA`` for NULL, as R's ``write_csv`` does.
    ``fmt="csv_file"``: one file ``{base}/{name}.csv``, its rows in the order of ``df``
    (:func:`write_single_csv`).

    The result is staged beside its place and moved there when it is complete, so a write that
    fails leaves what was there before, and nothing half done.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    out = df if digits is None else round_numeric(df, digits, mode)
    spark = df.sparkSession
    staged = os.path.join(base, f"_staged-{name}-{uuid.uuid4().hex}")
    path = os.path.join(base, f"{name}.csv" if fmt == "csv_file" else name)
    try:
        if fmt == "csv_file":
            write_single_csv(out, staged)
        elif fmt == "csv":
            out.write.option("header", True).option("nullValue", "NA").csv(staged)
        else:
            out.write.parquet(staged)
        publish(spark, staged, path)
    except BaseException:
        remove(spark, staged)
        raise
    return path


def write_single_csv(df: DataFrame, path: str) -> None:
    """``df`` as one CSV file: the header once, then the rows in the order of ``df``.

    The partitions are written in parallel, without headers; their files, which Spark numbers in order,
    are then joined by the file system (:func:`shelfwise.files.join_files`). No task holds the result.
    """
    spark, parts = df.sparkSession, f"{path}-parts"
    options = {"nullValue": "NA", "header": False}
    head = [tuple(df.columns)]
    names = spark.createDataFrame(head, ", ".join(f"c{i} string" for i in range(len(df.columns)))).coalesce(1)
    try:
        names.write.options(**options).csv(os.path.join(parts, "0-head"))
        df.write.options(**options).csv(os.path.join(parts, "1-rows"))
        files = [f.path for f in listing(spark, parts) if f.path.endswith(".csv")]
        join_files(spark, files, path)
    finally:
        remove(spark, parts)
