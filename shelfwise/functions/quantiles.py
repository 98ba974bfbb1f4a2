"""Exact quantiles (linear interpolation, "type 7") without holding a group in one task.

Spark's ``percentile`` keeps a map of every distinct value of a group in one aggregation
buffer and merges it in a single task -- fine for small groups, fatal for a group holding a
third of a 100 TB table. This operator narrows brackets instead. The rows are read twice:

1. A bounded sketch per group (``percentile_approx``, rank error at most n / ``ACCURACY``) gives a
   value safely below and one safely above each requested quantile, with the group's count.
2. Each value falls below, into, or above each bracket. Below and above only a count and the
   nearest value are kept; values inside keep their multiplicity. All of it is combined map-side,
   so what is shuffled follows the brackets (about 4 n / ``ACCURACY`` values), not the table.

What is left of a group can still be much (4e7 values of 1e12 rows), so each bracket is narrowed once
more, on what the second pass has shuffled already: a second sketch cuts it into ``SPLITS`` bins of about
equally many values, the bins' counts are summed up, and only the at most two bins that hold the wanted
ranks are sorted. A window partition holds ``SPLITS`` bins or one bin (3e5 values of 1e12 rows).

Running counts over a bin then give every value its rank interval, and the (at most two) values
whose interval covers a requested rank are interpolated:
``q(p) = x[k] + (h - k) * (x[k+1] - x[k])`` with ``h = (n - 1) p``, ``k = floor(h)``.

The bracket of p reaches from the sketch's quantile at ``p - 2 / ACCURACY`` to that at
``p + 2 / ACCURACY``: beyond the sketch's own error by one more, and with the nearest value on
either side it holds both ranks around h for any n. The second sketch decides only how even the bins
are. NULL values are ignored (as ``na.rm=TRUE``); a group with no non-NULL value yields no row unless
``keep_empty`` (ungrouped: a row of NULLs); a NULL group key is a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000
SPLITS = 128


def quantile_column_name(p: float, prefix: str = "q") -> str:
    return f"{prefix}{round(p * 100, 6):g}".replace(".", "_")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of key columns, NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _bracketed(values: DataFrame, keys: list[str], probs: list[float], accuracy: int, grouped: bool) -> DataFrame:
    """Per group, quantile ``i`` and distinct value inside its bracket a row with its count ``_c``; one row
    for what lies below (``side`` -1) and above (1). A group without values has rows with a count of 0."""
    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-2 / accuracy, 2 / accuracy)]
    sketch = [
        F.count("_v").alias("_n"),
        F.avg("_v").alias("_mean"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
    ]
    if grouped:
        bounds = values.groupBy(*[F.col(k).alias(f"{k}_b") for k in keys]).agg(*sketch)
        bounded = values.join(bounds, _same(keys, [f"{k}_b" for k in keys]))
    else:
        only = values.agg(F.struct(*sketch).alias("b")).scalar()
        bounded = values.select("*", *[only.getField(c).alias(c) for c in ("_n", "_mean", "_edges")])
    v = F.col("_v")

    def side(i: int) -> Column:
        low, high = F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]
        return F.when(v < low, -1).when(v > high, 1).otherwise(0)

    sides = F.array(*[F.struct(F.lit(i).alias("i"), side(i).alias("side")) for i in range(len(probs))])
    placed = bounded.select(*keys, "_n", "_mean", "_v", F.explode(sides).alias("_s"))
    return placed.groupBy(
        *keys, "_n", "_mean", "_s.i", "_s.side", F.when(F.col("_s.side") == 0, v).alias("_inside")
    ).agg(F.count("_v").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))


def _binned(counted: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """Each bracket's rows with the bin they fall into: -1 below, 0 .. ``splits`` - 1 inside, ``splits`` above."""
    cuts = [j / splits for j in range(1, splits)]
    renamed = [f"{k}_s" for k in keys]
    sketch = (
        counted.filter(F.col("_inside").isNotNull())
        .groupBy(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], F.col("i").alias("_i_s"))
        .agg(F.percentile_approx("_inside", cuts, 20 * splits).alias("_cuts"))
    )
    at = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_inside"))))
    bin_ = F.when(F.col("side") == -1, -1).when(F.col("side") == 1, splits).otherwise(at)
    joined = counted.join(sketch, _same([*keys, "i"], [*renamed, "_i_s"]), "left")
    return joined.withColumn("_bin", bin_).drop(*renamed, "_i_s", "_cuts")


def _known_ranks(binned: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, _n, _mean, i, _x, _from, _to): values with the ranks they hold, from the bins that hold a
    wanted rank."""
    upto = Window.partitionBy(*keys, "i").orderBy("_bin")
    bins = binned.groupBy(*keys, "_n", "i", "_bin").agg(F.sum("_c").alias("_in_bin"))
    bins = bins.withColumn("_start", F.sum("_in_bin").over(upto) - F.col("_in_bin"))
    h = (F.col("_n") - 1) * F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1)

    def holds(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_in_bin"))

    renamed = [f"{c}_t" for c in (*keys, "i", "_bin")]
    wanted = bins.filter(holds(F.floor(h)) | holds(F.ceil(h)) | (F.col("_n") == 0)).select(
        *[F.col(c).alias(r) for c, r in zip((*keys, "i", "_bin"), renamed)], "_start"
    )
    within = (
        Window.partitionBy(*keys, "i", "_bin")
        .orderBy("_inside")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = binned.join(wanted, _same((*keys, "i", "_bin"), renamed)).withColumn(
        "_end", F.col("_start") + F.sum("_c").over(within)
    )
    # Of the values below a bracket the greatest is known, of those above it the least.
    return rows.select(
        *keys,
        "_n",
        "_mean",
        "i",
        F.when(F.col("side") == -1, F.col("_max")).otherwise(F.col("_min")).alias("_x"),
        F.when(F.col("side") == -1, F.col("_end") - 1).otherwise(F.col("_end") - F.col("_c")).alias("_from"),
        F.when(F.col("side") == 1, F.col("_end") - F.col("_c") + 1).otherwise(F.col("_end")).alias("_to"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    mean_name: str | None = None,
    accuracy: int = ACCURACY,
    splits: int = SPLITS,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per group: ``by`` columns, ``n`` (non-NULL count) and one column per prob; with
    ``mean_name`` also the mean, from the first pass. ``keep_empty``: a group without a value has a row
    too, with n = 0 and NULLs."""
    by, probs = list(by), [float(p) for p in probs]
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    names = list(names) if names is not None else [quantile_column_name(p) for p in probs]
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    values = df.select(
        *([F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(1).alias("_k0")]),
        F.col(value).cast("double").alias("_v"),
    )
    if not keep_empty:
        values = values.where(F.col("_v").isNotNull())
    counted = _bracketed(values, keys, probs, accuracy, bool(by))
    known = _known_ranks(_binned(counted, keys, splits), keys, probs)

    def at(i: int, rank: Column) -> Column:
        hit = (F.col("i") == i) & (F.col("_from") <= rank) & (rank < F.col("_to"))
        return F.max(F.when(hit, F.col("_x")))

    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        aggs += [at(i, F.floor(h)).alias(f"_lo{i}"), at(i, F.ceil(h)).alias(f"_hi{i}")]
    found = known.groupBy(*keys, "_n", "_mean").agg(*aggs)
    out = [F.col(k).alias(c) for c, k in zip(by, keys)] + [F.col("_n").alias("n")]
    if mean_name is not None:
        out.append(F.col("_mean").alias(mean_name))
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(p)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    result = found.select(*out)
    if not by:  # one row in any case, as an ungrouped aggregate has
        result = result.agg(*[F.max(c).alias(c) for c in result.columns])
    return result


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, [0.5], by=by, names=[name]).drop("n")


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    method: str = "exact",
    accuracy: int = 100000,
) -> DataFrame:
    """``method="exact"``: :func:`exact_quantiles`. ``method="approx"``: one pass with
    ``percentile_approx`` (bounded sketch per group; returns observed values, rank error at
    most n/accuracy, no interpolation). Same output shape: ``by``, ``n``, one column per prob."""
    if method == "exact":
        return exact_quantiles(df, value, probs, by=by, names=names)
    if method != "approx":
        raise ValueError(f"unknown quantile method {method!r}")
    names = list(names) if names is not None else [quantile_column_name(p) for p in probs]
    v = F.col(value).cast("double")
    agg = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.percentile_approx(v, [float(p) for p in probs], accuracy).alias("_q")
    )
    return agg.where(F.col("n") > 0).select(
        *by, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)]
    )
