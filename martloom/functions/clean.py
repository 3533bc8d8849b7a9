"""Typed readings of the all-text staging columns.

ANSI mode stays on, so nothing here may throw on bad text: a text that does not
read as the wanted type becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the date format of the exports.
DATE_FORMAT = "M/d/yyyy"


def text(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def int_or_null(column: str | Column) -> Column:
    """`'12'`, `' 7 '` and `'1.7'` (cut to 1) are ints; `''`, `'1e2'`, `'abc'` are NULL.

    The regular expression runs only for texts that are no plain int.
    """
    c = text(column)
    whole_part = F.regexp_extract(c, r"^\s*([+-]?\d+)\.\d*\s*$", 1)
    return F.coalesce(c.try_cast("int"), whole_part.try_cast("int"))


def double_or_null(column: str | Column) -> Column:
    """Every finite number; NaN and Infinity are no readings."""
    number = text(column).try_cast("double")
    # NaN sorts above every number, so one comparison drops both.
    return F.when(F.abs(number) < float("inf"), number)


def date_or_null(column: str | Column) -> Column:
    return F.try_to_date(text(column), DATE_FORMAT)


def present(column: str | Column) -> Column:
    """Neither NULL nor the empty text."""
    c = text(column)
    return c.isNotNull() & (c != "")


def or_blank(column: str | Column) -> Column:
    return F.coalesce(text(column), F.lit(""))
