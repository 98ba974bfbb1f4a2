"""Sink-side rounding of every fractional column (operators themselves never round)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


#: A double has 15 certain decimal digits; a place beyond them is left alone.
DIGITS = 15


def _nearest(col, digits: int):
    """Of the two neighbours with ``digits`` places, the one whose *double* is nearer to the value's; of
    equally near ones that with the even last digit.

    The stored number decides, not its printed form: 2.675 is stored a little below, so it becomes
    2.67, and 0.15 becomes 0.1. Distances between neighbouring doubles are exact.
    """
    x = col.cast(T.DoubleType())
    size = F.abs(x)
    scale = F.lit(float(10 ** abs(digits)))
    units = size * scale if digits >= 0 else size / scale
    back = (lambda n: n / scale) if digits >= 0 else (lambda n: n * scale)
    low, high = F.floor(units).cast(T.DoubleType()), F.ceil(units).cast(T.DoubleType())
    below, above = size - back(low), back(high) - size
    chosen = F.when(below < above, back(low)).when(above < below, back(high)).when(low % 2 == 0, back(low))
    # Adding 0.0 makes a zero that came from below a plain one.
    rounded = F.when(x < 0, -chosen.otherwise(back(high))).otherwise(chosen.otherwise(back(high))) + 0.0
    rest = F.isnan(x) | (size >= F.lit(float(10 ** max(DIGITS - digits, 0))))
    return F.when(rest, x).otherwise(rounded)


def round_value(col, digits: int = 2, mode: str = "half_up"):
    """Round a fractional column to ``digits`` places.

    ``half_up`` and ``half_even`` round the decimal that prints the value, the shortest one that reads
    back as the same double: 0.125 -> 0.13 and 0.12, and 2.675 -> 2.68 in both, although the double lies
    a little below. ``nearest`` rounds the stored double (:func:`_nearest`), as R does: 2.675 -> 2.67,
    0.125 -> 0.12. A decimal column is exact, so ``nearest`` is ``half_even`` there.
    """
    if mode == "half_up":
        return F.round(col, digits)
    if mode == "half_even":
        return F.bround(col, digits)
    if mode == "nearest":
        return _nearest(col, digits)
    raise ValueError(f"unknown rounding mode {mode!r}")


def comparable_value(col, digits: int = 2):
    """For comparing two engines only: values that differ in the order of summation (an exact
    38633.275 against 38633.274999999998) must not fall on two sides of a tie, so the value is
    put on twelve significant digits before it is rounded. No sink uses it."""
    steady = F.format_string("%.11e", col.cast(T.DoubleType())).cast(T.DoubleType())
    value = F.when(col.isNotNull() & ~F.isnan(col.cast(T.DoubleType())), steady)
    snapped = F.round(value.try_cast(T.DecimalType(38, 10)), digits).cast(T.DoubleType())
    return F.coalesce(snapped, F.round(col, digits))


def round_numeric(
    df: DataFrame, digits: int = 2, mode: str = "half_up", comparable: bool = False
) -> DataFrame:
    """Round all fractional columns to ``digits``; integers, strings and dates pass through.
    ``comparable``: by :func:`comparable_value`.

    One projection, so it fuses into the producing stage's generated code.
    """
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = round_value(col, digits, "half_even" if mode == "nearest" else mode).alias(field.name)
        elif isinstance(field.dataType, _FRACTIONAL):
            value = comparable_value(col, digits) if comparable else round_value(col, digits, mode)
            col = value.alias(field.name)
        cols.append(col)
    return df.select(*cols)
