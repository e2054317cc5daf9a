"""Null, tie and ratio rules of the analyses, as column expressions.

Spark SQL and the analyses disagree on a handful of corner cases. Each rule is spelled out
once here, and every other module goes through these helpers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def not_in(value: Column, members: Iterable) -> Column:
    """True unless ``value`` is one of ``members``; a null value passes."""
    return ~F.coalesce(value.isin(list(members)), F.lit(False))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice in which an unknown condition gives an unknown answer."""
    return F.when(condition, yes).when(~condition, no)


def count_distinct(value: Column, count_null: bool = True) -> Column:
    """Distinct count in which null is one more value, if it occurs."""
    known = F.count_distinct(value)
    if not count_null:
        return known
    return known + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))


def mode(value: Column) -> Column:
    """Most frequent value; the smallest one if several are equally frequent.

    Keeps a count per value while it runs: meant for values of a small domain, such as weekdays.
    """
    return F.mode(value, deterministic=True)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def null_last(*columns: Column) -> Column:
    """Sort key that compares like the given columns, with nulls after every value."""
    parts = []
    for c in columns:
        parts += [c.isNull(), c]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def fill_null(value: Column, filler) -> Column:
    return F.coalesce(value, F.lit(filler))
