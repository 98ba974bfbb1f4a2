"""Helpers shared by the operators: shared-folder tables, salted totals, token columns.

Every operator selects the columns it needs under its own names first, so extra columns of any
name in its input cannot clash with what it computes.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import pinned as written
from shelfwise.session import shared_dir

#: The characters that separate words in every contract: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's limit on the bytes of an Arrow batch, so that rows with long texts or lists
    do not fill a worker ten thousand at a time. Only batch sizes depend on it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = conf.get(key).lower().removesuffix("b")
    if not limit.isdigit() or not 0 < int(limit) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def _release() -> None:
    """Hands memory that Arrow and the C library keep for later back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, after which the worker keeps no freed memory. A worker outlives its
    tasks, and shares its machine with others."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            _release()

    return run


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (the context cleaner may delete it once it is unreachable)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Recent(dict):
    """A worker's bounded cache: key -> ``make(key)``. Two generations of ``most`` keys each; what
    was not asked for during a whole generation is forgotten. Only speed depends on it."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self._turn()
        self[key] = value

    def put_all(self, found: dict) -> None:
        self._turn()
        self.update(found)

    def _turn(self) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()


def salt(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("salt")), F.lit(salts)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: it is bound as the only entry of an array. An expression
    that is merely named in Python is computed, and stands in the plan, at each place where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
