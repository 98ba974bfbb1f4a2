"""An open registry of data checks: state a check and what to expect, get it in the report.

A check measures a *relation* of the star (a table, or one of the prepared relations below), or is
a SQL statement or a DataFrame of its own. All checks on one relation are measured in one
aggregation, so a fact is read once however many checks look at it.

Relations besides the five tables:

* ``references``: one row per customer or product id that any table holds (kind, key, and how many
  invoices, receipts and dimension rows carry it);
* ``sale_matches``: invoices against the shipments of their sale, collapsed per quantity and day
  (``n`` shipments), with what is missing on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.star import TABLE_NAMES, Star

REPORT_COLUMNS = ("check", "metric", "value", "expectation", "passed")


@dataclass(frozen=True)
class Expected:
    """A range for a value: at least ``low`` (``above``: more than it), at most ``high``."""

    low: float | None = None
    high: float | None = None
    above: bool = False
    text: str | None = None

    def __str__(self) -> str:
        if self.text is not None:
            return self.text
        if self.low is not None and self.low == self.high:
            return f"{self.low:g}"
        parts = [] if self.low is None else [f"{'>' if self.above else '>='}{self.low:g}"]
        parts += [] if self.high is None else [f"<={self.high:g}"]
        return " ".join(parts) or "reported"

    def holds(self, value: Column) -> Column:
        """False for a value that is NULL."""
        bounds = [value.isNotNull()]
        if self.low is not None:
            bounds.append(value > self.low if self.above else value >= self.low)
        if self.high is not None:
            bounds.append(value <= self.high)
        return F.coalesce(reduce(lambda a, b: a & b, bounds), F.lit(False))


#: Any value will do, but there must be one.
REPORTED = Expected()
ZERO = Expected(0, 0)
POSITIVE = Expected(0, above=True)


def about(value: float, tolerance: float, unit: str = "") -> Expected:
    return Expected(value - tolerance, value + tolerance, text=f"~{value:g}{unit}")


@dataclass(frozen=True)
class Check:
    """One check. ``metrics``: name -> aggregate over the relation ``on`` (a Column or SQL text). Or
    ``sql``, a statement over ``{customers}``, ``{products}``, ``{sales_invoices}``, ``{shipments}`` and
    ``{receipts}``; or ``frame``, which builds a DataFrame from the star. ``expected``: for all metrics, or
    per name."""

    title: str
    metrics: dict[str, Column | str] = field(default_factory=dict)
    on: str | None = None
    sql: str | None = None
    frame: Callable[[Star], DataFrame] | None = None
    expected: Expected | dict[str, Expected] = REPORTED

    def __post_init__(self):
        if sum(x is not None for x in (self.on, self.sql, self.frame)) != 1:
            raise ValueError(f"check {self.title!r} needs one of on, sql and frame")
        if bool(self.metrics) != (self.on is not None):
            raise ValueError(f"check {self.title!r}: metrics go with a relation")

    def expects(self, metric: str) -> Expected:
        return self.expected if isinstance(self.expected, Expected) else self.expected.get(metric, REPORTED)


def measure(title: str, on: str, expected: Expected | dict[str, Expected] = REPORTED, **metrics: Column | str) -> Check:
    return Check(title, metrics=metrics, on=on, expected=expected)


def sql_check(title: str, sql: str, expected: Expected | dict[str, Expected] = REPORTED) -> Check:
    return Check(title, sql=sql, expected=expected)


def frame_check(
    title: str, frame: Callable[[Star], DataFrame], expected: Expected | dict[str, Expected] = REPORTED
) -> Check:
    return Check(title, frame=frame, expected=expected)


def references(star: Star) -> DataFrame:
    """One row per customer or product id that a fact or dimension holds: (kind, key, sales, receipts,
    dimension), how many rows of each carry it. A NULL id has a row too.

    Child and parent keys are tagged, stacked and aggregated together. Each table is read once, the
    counts are combined before the shuffle, and no key meets another table's rows in a join.
    """

    def tagged(df: DataFrame, kinds: dict[str, str], role: str) -> DataFrame:
        entries = [F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key")) for column, kind in kinds.items()]
        marks = [F.lit(int(role == r)).alias(r) for r in ("sales", "receipts", "dimension")]
        return df.select(F.explode(F.array(*entries)).alias("k"), *marks).select("k.*", *marks)

    rows = (
        tagged(star.sales, {"customer_id": "customer", "product_id": "product"}, "sales")
        .union(tagged(star.receipts, {"product_id": "product"}, "receipts"))
        .union(tagged(star.customers, {"customer_id": "customer"}, "dimension"))
        .union(tagged(star.products, {"product_id": "product"}, "dimension"))
    )
    return rows.groupBy("kind", "key").agg(*[F.sum(r).alias(r) for r in ("sales", "receipts", "dimension")])


def sale_matches(star: Star) -> DataFrame:
    """(sales_id, quantity, sale_date, invoiced, quantity_sold, shipment_date, n): invoices in a full join
    with their shipments per quantity and day. ``n`` is NULL for an invoice without shipments, ``invoiced``
    for shipments without an invoice."""

    def against(invoices: DataFrame, shipments: DataFrame) -> DataFrame:
        collapsed = shipments.groupBy(
            F.col("sales_id").alias("_sale"), "quantity_sold", F.col("date").alias("shipment_date")
        ).agg(F.count(F.lit(1)).alias("n"))
        invoiced = invoices.select(
            "sales_id", "quantity", F.col("date").alias("sale_date"), F.lit(True).alias("invoiced")
        )
        return invoiced.join(collapsed, F.col("sales_id") == F.col("_sale"), "full").drop("_sale")

    return star.by_sale(against)


RELATIONS: dict[str, Callable[[Star], DataFrame]] = {
    **{name: (lambda star, name=name: star.tables()[name]) for name in TABLE_NAMES},
    "references": references,
    "sale_matches": sale_matches,
}


def _entry(order: int, check: Check, metric: Column | str, value: Column, expected: Expected) -> Column:
    value = value.cast("double")
    name = F.lit(metric) if isinstance(metric, str) else metric
    return F.struct(
        F.lit(order).alias("_ord"),
        F.lit(check.title).alias("check"),
        name.alias("metric"),
        value.alias("value"),
        F.lit(str(expected)).alias("expectation"),
        expected.holds(value).alias("passed"),
    )


def _measured(relation: DataFrame, checks: list[tuple[int, Check]]) -> DataFrame:
    """One aggregation for all checks of a relation."""
    measures, entries = [], []
    for order, check in checks:
        for metric, measure_ in check.metrics.items():
            name = f"_m{len(measures)}"
            measures.append((F.expr(measure_) if isinstance(measure_, str) else measure_).alias(name))
            entries.append(_entry(order, check, metric, F.col(name), check.expects(metric)))
    return relation.agg(*measures).select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def _own_rows(star: Star, order: int, check: Check) -> DataFrame:
    """A check with a result of its own. Its numeric columns are the metrics; a text column in front
    labels the rows, and without one there is one row (the first; NULLs if there is none)."""
    if check.frame is not None:
        result = check.frame(star)
    else:
        result = star.sales.sparkSession.sql(check.sql, **star.tables())
    fields = result.schema.fields
    label = fields[0].name if fields and fields[0].dataType.typeName() in ("string", "varchar", "char") else None
    columns = [f.name for f in fields if f.name != label]
    if label is None:
        result = result.agg(*[F.first(f"`{c}`").alias(c) for c in columns])
    entries = []
    for c in columns:
        # The label names the row; a second numeric column needs its own name beside it.
        metric = c if label is None else F.col(f"`{label}`") if len(columns) == 1 else F.concat_ws(".", f"`{label}`", F.lit(c))
        entries.append(_entry(order, check, metric, F.col(f"`{c}`"), check.expects(c)))
    return result.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def run_checks(star: Star, checks: Sequence[Check]) -> DataFrame:
    """(check, metric, value, expectation, passed), in the order of the checks. A relation is read once
    for all checks on it; a value that is NULL does not pass."""
    grouped: dict[str, list[tuple[int, Check]]] = {}
    parts = []
    for order, check in enumerate(checks):
        if check.on is None:
            parts.append(_own_rows(star, order, check))
        elif check.on not in RELATIONS:
            raise ValueError(f"check {check.title!r}: unknown relation {check.on!r}; known are {sorted(RELATIONS)}")
        else:
            grouped.setdefault(check.on, []).append((order, check))
    parts += [_measured(RELATIONS[name](star), group) for name, group in grouped.items()]
    if not parts:
        raise ValueError("no checks")
    return reduce(DataFrame.unionByName, parts).orderBy("_ord", "metric").select(*REPORT_COLUMNS)


class CheckRegistry:
    """Checks by title, in the order they were added; a title can be replaced."""

    def __init__(self, checks: Sequence[Check] = ()):
        self._checks: dict[str, Check] = {}
        for check in checks:
            self.add(check)

    def add(self, check: Check) -> Check:
        self._checks[check.title] = check
        return check

    def remove(self, title: str) -> None:
        del self._checks[title]

    def __iter__(self):
        return iter(self._checks.values())

    def __len__(self) -> int:
        return len(self._checks)

    def run(self, star: Star) -> DataFrame:
        return run_checks(star, list(self))
