from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import build_session, checkpoint_dir  # noqa: E402
from shelfwise.sources.contracts import CONTRACTS  # noqa: E402
from shelfwise.sources.star import Star  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="shelfwise-tests-")
    s = build_session(
        "local[4]",
        app_name="shelfwise-tests",
        shuffle_partitions=4,
        extra={"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")},
    )
    s.sparkContext.setLogLevel("ERROR")
    # Tests have no cluster-provided shared folder: install a scratch one only because it is unset.
    checkpoint_dir(s, fallback=os.path.join(scratch, "checkpoint"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="shelfwise-test-")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def make_star(spark, customers=(), products=(), sales=(), shipments=(), receipts=()) -> Star:
    """Star from tuples in contract column order."""
    frames = [
        spark.createDataFrame(list(rows), CONTRACTS[name])
        for name, rows in zip(CONTRACTS, (customers, products, sales, shipments, receipts))
    ]
    return Star(*frames)


def rows(df, *cols):
    """Collect as a sorted list of tuples (None sorts first)."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))
