"""Exact money: decimals inside the aggregates, doubles only on output.

A sum of doubles depends on the order of the rows, hence on the partitioning;
a sum of decimals does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(28,6)"
# An amount from here on does not fit; it stops the job by name instead of vanishing.
AMOUNT_LIMIT = 1e22
_COUNT = "decimal(13,0)"


def exact(column: Column) -> Column:
    message = F.concat(F.lit("amount of 10^22 or more: "), column.cast("string"))
    return F.when(F.abs(column) >= AMOUNT_LIMIT, F.raise_error(message)).otherwise(column.cast(AMOUNT))


def times(amount: Column, count: Column) -> Column:
    return exact(amount) * count.cast(_COUNT)


def cents(total: Column) -> Column:
    """Round half up to two digits and leave the exact type."""
    return F.round(total, 2).cast("double")


def average(total: Column, count: Column) -> Column:
    """`total / count` in cents; NULL when there is nothing to average.

    The whole part is split off first, so the rest keeps 20 digits after the point: rounding
    it to cents equals rounding the true quotient, whatever the total, for up to 10^13 rows.
    """
    count = F.nullif(count, F.lit(0)).cast(_COUNT)
    rest = total % count
    whole = ((total - rest) / count).cast("decimal(32,0)")
    return (whole + F.round(rest / count, 2)).cast("double")
