"""Plan shapes of every registered key with broadcasts disabled (data-sized dimensions).

Usage: python tools/plan_shapes.py [sf_dir]  -> JSON {key: {"plain": {...}, "bucketed": {...}}}
Counts hash / range / single-partition exchanges, broadcasts, sort-merge joins and Arrow
Python nodes in the initial physical plan, for a plain and a co-bucketed landing.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.plans.registry import OPERATORS, run  # noqa: E402
from shelfwise.session import build_session, checkpoint_dir  # noqa: E402
from shelfwise.sources.landing import land_star  # noqa: E402
from shelfwise.sources.tpch_fixture import star_from_tpch  # noqa: E402

PATTERNS = {
    "hash": r"Exchange hashpartitioning",
    "range": r"Exchange rangepartitioning",
    "single": r"Exchange SinglePartition",
    "bcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "python": r"ArrowEvalPython",
}


def shape(df) -> dict[str, int]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    text = buf.getvalue()
    return {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(
        "local[8]",
        shuffle_partitions=8,
        extra={
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="shelfwise-shapes-"))
    src = star_from_tpch(spark, sf_dir)
    plain = land_star(spark, src, os.path.join(base, "shapes_plain"))
    buck = land_star(spark, src, os.path.join(base, "shapes_bucketed"), buckets=8)
    out = {k: {"plain": shape(run(k, plain)), "bucketed": shape(run(k, buck))} for k in OPERATORS}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
