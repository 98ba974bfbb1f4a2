"""Session settings the operators are designed around.

The operators never hard-code a join strategy. Broadcasts are chosen by Spark behind two size
checks -- the static plan estimate (``spark.sql.autoBroadcastJoinThreshold``) and the measured
shuffle size at runtime (``spark.sql.adaptive.autoBroadcastJoinThreshold``) -- and fall back to a
sort-merge join beyond them. Skewed join partitions are split by AQE.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shelfwise.files import remove

# Defaults tuned for a large cluster; callers may override any of them.
SCALE_DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Broadcast only sides measured below 32 MB; anything larger is sort-merge joined.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "shelfwise",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with :data:`SCALE_DEFAULTS` applied.

    ``master`` is left to ``spark-submit`` when ``None``. The UI is off: nothing here needs it.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for materialised intermediates.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared, durable folder
    there). Only when it is unset -- tests, a laptop -- is ``fallback`` installed. Raises when
    neither exists, rather than silently writing to a machine-local folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if fallback is None or sc is None:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder as fallback")
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback


#: The fallback folder of a local master, made once per process, and only if it is needed.
_LOCAL_FALLBACK: list[str] = []

#: Paths handed out by :func:`fresh_path` while :func:`intermediates` watches, innermost last.
_WATCHED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """:func:`checkpoint_dir`; only a local master may fall back to a temporary folder."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise
    if not _LOCAL_FALLBACK:
        _LOCAL_FALLBACK.append(tempfile.mkdtemp(prefix="shelfwise-"))
    return checkpoint_dir(spark, fallback=_LOCAL_FALLBACK[0])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; two runs never write to the same place."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    for paths in _WATCHED:
        paths.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, on leaving, every table that was pinned in the shared folder inside. Results that read one
    must have been written by then."""
    paths: list[str] = []
    _WATCHED.append(paths)
    try:
        yield paths
    finally:
        _WATCHED.remove(paths)
        for path in paths:
            remove(spark, path)


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, re-readable
    after the loss of any executor. It stays until :func:`intermediates` or the owner deletes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
