"""shelfwise: retail star-schema reports and statistics as lazy Spark DataFrame operators.

Every operator takes a :class:`~shelfwise.sources.star.Star` (five DataFrames) plus keyword
parameters and returns a lazy DataFrame. Nothing is collected to the driver; all aggregation
runs on executors, so the same code serves a laptop sample and fact tables of billions of rows.
"""

from shelfwise.sources.star import Star

__all__ = ["Star"]
