"""Named plans: every operator bound to its fixture parameters, over a resolvable source path.

``plan(name)(spark, path)`` loads the star schema at ``path`` (landed Parquet, the CSV drop, or
TPC-H tables), runs the operator and rounds fractional columns to 2 places, in the form that
compares between engines. The result is lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.rounding import round_numeric
from shelfwise.operators.reports import REPORTS
from shelfwise.operators.stats import STATS
from shelfwise.operators.summary import statistical_summary
from shelfwise.operators.validation import CHECKS
from shelfwise.plans.incremental import statistical_summary_batches
from shelfwise.plans.params import FIXTURE
from shelfwise.sources.readers import load_star
from shelfwise.sources.star import Star

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    **CHECKS,
    **REPORTS,
    **STATS,
    "statistical_summary": statistical_summary,
    "statistical_summary_batches": statistical_summary_batches,
}

#: Columns whose size says nothing at two places; registered plans add their logarithm.
P_VALUES = ("p_value", "f_p_value")

_STARS: dict[str, tuple[SparkSession, Star]] = {}


def star_for(spark: SparkSession, path: str) -> Star:
    """One lazy :class:`Star` per path for the current session; resolving it only lists files.

    The cache holds the session object it was built with and is rebuilt for any other
    session, so a stopped-and-recreated session never receives stale DataFrames.
    """
    cached = _STARS.get(path)
    if cached is None or cached[0] is not spark:
        _STARS[path] = (spark, load_star(spark, path))
    return _STARS[path][1]


def run(name: str, star: Star, digits: int | None = 2, **overrides) -> DataFrame:
    params = {**FIXTURE.get(name, {}), **overrides}
    df = OPERATORS[name](star, **params)
    for column in P_VALUES:
        if column in df.columns:
            p = F.col(column)
            df = df.withColumn(f"{column}_log10", F.when(p > 0, F.log10(p)))
    return df if digits is None else round_numeric(df, digits, comparable=True)


def plan(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, path: str) -> DataFrame:
        return run(name, star_for(spark, path))

    build.__name__ = name
    return build


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan(name) for name in OPERATORS}
