"""Ordinary least squares with one predictor, in closed form from mergeable aggregates.

``regr_count/avgx/avgy/sxx/syy/sxy`` are partial/final aggregates (only a handful of doubles
per group cross the shuffle), so a fit over a billion rows or over millions of groups never
materialises its rows anywhere. All regr_* aggregates use complete (x, y) pairs only, which is
what ``lm``'s default ``na.omit`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOMENTS = ("_n", "_ax", "_ay", "_sxx", "_syy", "_sxy")


def ols_moments(y: str | Column, x: str | Column, prefix: str = "") -> list[Column]:
    """Aggregate expressions for the sufficient statistics of ``y ~ x``.

    ``prefix`` namespaces the outputs when several fits share one aggregation; read them back
    with :func:`unprefixed` before using the closed forms below.
    """
    exprs = (F.regr_count, F.regr_avgx, F.regr_avgy, F.regr_sxx, F.regr_syy, F.regr_sxy)
    return [fn(y, x).alias(prefix + name) for fn, name in zip(exprs, MOMENTS)]


def unprefixed(prefix: str) -> list[Column]:
    return [F.col(prefix + name).alias(name) for name in MOMENTS]


#: Parts of a centred moment set that merge over disjoint row sets (see :func:`centred_moments`).
PARTS = (*MOMENTS, "_xlo", "_xhi")


def centred_moments(y: Column, x: Column, prefix: str) -> list[Column]:
    """Count, means and centred sums of the complete (x, y) pairs, and the range of x.

    They merge without power sums (:func:`fold_moments`), so a fact table can be reduced on its join
    key before the join, and no sum of large squares is ever subtracted from another.
    """
    both = y.isNotNull() & x.isNotNull()
    xs = F.when(both, x.cast("double"))
    return [
        *ols_moments(y.cast("double"), x.cast("double"), prefix),
        F.min(xs).alias(prefix + "_xlo"),
        F.max(xs).alias(prefix + "_xhi"),
    ]


#: Salted lists a group's moment sets are folded through. The second fold of a group never sees more
#: than this many, the first one a share of the group's parts.
SALTS = 4096


#: An empty set's parts, as SQL.
_EMPTY = {c: "0L" if c == "_n" else "cast(null AS double)" if c in ("_xlo", "_xhi") else "0D" for c in PARTS}


def _states(prefix: str) -> list[str]:
    """The :data:`PARTS` of one moment set as struct entries: an empty set has zeros, not NULLs."""
    return [f"'{prefix}{c}', coalesce({prefix}{c}, {_EMPTY[c]})" for c in PARTS]


def _merged(prefix: str) -> list[str]:
    """Entries of the struct that merges the moment sets of two disjoint row sets ``a`` and ``b``: counts add
    up, means move by the second set's share, centred sums add up plus the spread between the means."""
    a, b = f"a.{prefix}", f"b.{prefix}"
    n = f"({a}_n + {b}_n)"
    share = f"coalesce(try_divide(cast({b}_n AS double), {n}), 0D)"
    dx, dy = f"({b}_ax - {a}_ax)", f"({b}_ay - {a}_ay)"
    weight = f"cast({a}_n AS double) * {share}"
    values = {
        "_n": n,
        "_ax": f"{a}_ax + {dx} * {share}",
        "_ay": f"{a}_ay + {dy} * {share}",
        "_sxx": f"{a}_sxx + {b}_sxx + {dx} * {dx} * {weight}",
        "_syy": f"{a}_syy + {b}_syy + {dy} * {dy} * {weight}",
        "_sxy": f"{a}_sxy + {b}_sxy + {dx} * {dy} * {weight}",
        "_xlo": f"least({a}_xlo, {b}_xlo)",
        "_xhi": f"greatest({a}_xhi, {b}_xhi)",
    }
    return [f"'{prefix}{c}', {values[c]}" for c in PARTS]


def fold_moments(
    parts: DataFrame, by: Sequence[str], key: str, prefixes: Sequence[str], sums: Sequence[str] = (), salts: int | None = SALTS
) -> DataFrame:
    """The moment sets of a group's rows merged into one row per ``by``: ``by``, the ``sums`` added up, and
    :data:`PARTS` of each prefix.

    ``parts`` holds one row per ``key``. It is read once: lists of moment sets, salted by the key, are
    folded pairwise in the JVM, then the at most ``salts`` folds of a group are folded again, so no
    list grows with a hot group beyond its share. ``salts=None``, for groups known to have few parts (at
    most :data:`SALTS`): one fold, so one shuffle. The order within a list is that of the keys, so
    results do not depend on how tasks finish. A regressor that never varies has centred sums of
    exactly 0; an empty set has a count of 0 and NULL means.
    """

    # As SQL text: one expression to parse instead of hundreds of calls.
    zero = ", ".join(f"'{prefix}{c}', {_EMPTY[c]}" for prefix in prefixes for c in PARTS)
    merge = ", ".join(entry for prefix in prefixes for entry in _merged(prefix))
    states = ", ".join(entry for prefix in prefixes for entry in _states(prefix))

    def fold(df: DataFrame, groups: list[str], order: str) -> DataFrame:
        entries = f"array_sort(collect_list(named_struct('_key', `{order}`, {states})))"
        folded = F.expr(f"aggregate({entries}, named_struct({zero}), (a, b) -> named_struct({merge}))")
        totals = [F.sum(c).alias(c) for c in sums]
        return df.groupBy(*groups).agg(*totals, folded.alias("_fold")).select("*", "_fold.*").drop("_fold")

    if salts is None:
        merged = fold(parts, [*by], key)
    else:
        salted = parts.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
        merged = fold(fold(salted, [*by, "_salt"], key), [*by], "_salt")
    out = [*by, *sums]
    for prefix in prefixes:
        some = F.col(prefix + "_n") > 0
        constant = F.col(prefix + "_xlo") == F.col(prefix + "_xhi")
        for c in PARTS:
            value = F.col(prefix + c)
            if c in ("_sxx", "_sxy"):
                value = F.when(some, F.when(constant, F.lit(0.0)).otherwise(value))
            elif c != "_n":
                value = F.when(some, value)
            out.append(value.alias(prefix + c))
    return merged.select(*out)


def slope() -> Column:
    """NULL when x is constant (R reports NA for the aliased coefficient)."""
    return F.try_divide(F.col("_sxy"), F.col("_sxx"))


def intercept() -> Column:
    """``mean(y) - slope * mean(x)``; with a constant x, R's fit is the mean of y."""
    return F.coalesce(F.col("_ay") - slope() * F.col("_ax"), F.col("_ay"))


def residual_df() -> Column:
    return F.col("_n") - 2


def sse() -> Column:
    """Residual sum of squares, clamped at 0 against cancellation on perfect fits."""
    return F.greatest(F.col("_syy") - slope() * F.col("_sxy"), F.lit(0.0))


def sigma() -> Column:
    """Residual standard error; NULL when fewer than 3 complete pairs."""
    return F.sqrt(F.try_divide(sse(), F.when(residual_df() > 0, residual_df())))


def r_squared() -> Column:
    return F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy"))


def adj_r_squared() -> Column:
    return F.lit(1.0) - (F.lit(1.0) - r_squared()) * F.try_divide(
        F.col("_n") - 1, F.when(residual_df() > 0, residual_df())
    )


def f_statistic() -> Column:
    """Model F on (1, n-2) df; equals the slope's t squared."""
    return F.try_divide(
        slope() * F.col("_sxy"),
        F.try_divide(sse(), F.when(residual_df() > 0, residual_df())),
    )


def se_slope() -> Column:
    return F.try_divide(sigma(), F.sqrt(F.col("_sxx")))


def se_intercept() -> Column:
    return sigma() * F.sqrt(
        F.try_divide(F.lit(1.0), F.col("_n"))
        + F.try_divide(F.col("_ax") * F.col("_ax"), F.col("_sxx"))
    )


def fit_columns() -> list[Column]:
    """Model-level summary of ``y ~ x`` (what ``summary.lm`` prints below the coefficients)."""
    return [
        F.col("_n").cast("bigint").alias("n"),
        intercept().alias("intercept"),
        slope().alias("slope"),
        r_squared().alias("r_squared"),
        adj_r_squared().alias("adj_r_squared"),
        sigma().alias("residual_std_error"),
        residual_df().cast("bigint").alias("df_residual"),
        f_statistic().alias("f_statistic"),
    ]
