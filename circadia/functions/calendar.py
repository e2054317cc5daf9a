"""Calendar keys (``yyyymmdd`` integers), weekdays and look-back limits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .semantics import if_else

# Weekday labels, Monday first, as the reports print them.
WEEKDAY_LABELS = {
    "short": ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"],
    "english": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
    "danish": ["Mandag", "Tirsdag", "Onsdag", "Torsdag", "Fredag", "Lørdag", "Søndag"],
}


def as_date(as_of=None) -> Column:
    """Reference day: today unless a date, an ISO string or a column is given."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def date_of_key(key: Column) -> Column:
    """Calendar key to date; a key that names no day gives null.

    Spelled as an ISO date and cast: far cheaper per row than parsing with a pattern, and short,
    so that it stays cheap where the optimizer copies it into several expressions.
    """
    spelled = F.overlay(F.overlay(key.cast("string"), F.lit("-"), 7, 0), F.lit("-"), 5, 0)
    return F.when(key.between(10000101, 99991231), spelled.try_cast("date"))


def key_of_date(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def days_before(as_of, days: int) -> Column:
    return F.date_sub(as_date(as_of), days)


def key_days_before(as_of, days: int) -> Column:
    """Calendar key of ``as_of`` minus ``days``. Folds to a literal, so it reaches the scan."""
    return F.date_format(days_before(as_of, days), "yyyyMMdd").cast("int")


def within_days(key: Column, as_of, days: int) -> Column:
    """Predicate on the stored key, so file and row-group statistics can prune."""
    return key >= key_days_before(as_of, days)


def iso_weekday(date: Column) -> Column:
    """Monday = 1 to Sunday = 7."""
    return (F.weekday(date) + 1).cast("int")


def weekday_label(weekday: Column, style: str = "english") -> Column:
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS[style]])
    return F.get(labels, weekday.cast("int") - 1)


def weekday_ordinal(label: Column, style: str = "english") -> Column:
    """Position of a label in its week, for ordering labels Monday first."""
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS[style]])
    return F.nullif(F.array_position(labels, label), F.lit(0)).cast("int")


def weekend_flag(weekday: Column) -> Column:
    """'yes' on Saturday and Sunday, else 'no'."""
    return if_else(weekday >= 6, F.lit("yes"), F.lit("no"))


def day_class(label: Column, style: str = "english") -> Column:
    """'Weekend' or 'Workday' for a weekday label."""
    return if_else(label.isin(WEEKDAY_LABELS[style][5:]), F.lit("Weekend"), F.lit("Workday"))
