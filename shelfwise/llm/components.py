"""Connected components of a link table by alternating star contraction.

Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node it
can see; both steps are an aggregate (combined before the shuffle) and a join that Spark may split
at a hot node. Rounds grow with the logarithm of the longest chain. Every round is checkpointed
reliably and only a row of totals comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import checkpointed


def _hung(directed: DataFrame, keep: str) -> DataFrame:
    """Per node u, its neighbours v (those that ``keep`` says) linked to the smallest node seen."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("m")
    )
    joined = directed.join(least, directed["u"] == least["node"])
    return joined.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _totals(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")
    ).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns u, v. Returns node, root for every node that has a link and is
    not itself the smallest of its component (roots are the smallest nodes)."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = checkpointed(edges.filter("u <> v").distinct())
    before = _totals(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _hung(both, "v > u").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        named = least.withColumnRenamed("u", "node")
        smaller = larger.join(named, larger["u"] == named["node"]).filter("v > m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        edges = checkpointed(smaller.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _totals(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
