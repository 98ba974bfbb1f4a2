"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """``first || ' ' || last``; NULL when either part is NULL (``concat``, not ``concat_ws``)."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def line_value(price: str = "unit_price", qty: str = "quantity") -> Column:
    """Invoice line value ``unit_price * quantity`` (the reference's revenue / spending)."""
    return F.col(price) * F.col(qty)


def days_between(end: str, start: str) -> Column:
    """Whole days from ``start`` to ``end`` as BIGINT."""
    return F.datediff(F.col(end), F.col(start)).cast("bigint")


def epoch_days(date_col: str) -> Column:
    """Days since 1970-01-01 (R's ``as.numeric(as.Date(x))``)."""
    return F.unix_date(F.col(date_col)).cast("double")


def pearson(y: str | Column, x: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL (no ANSI error) when either side is constant."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
