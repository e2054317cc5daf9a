"""When are people active? Counts and shares by weekday, hour, customer and category."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import weekday_label
from ..functions.semantics import count_distinct
from ..functions.text import log_intensity
from ..operators import sketches
from ..operators.grid import densify
from ..operators.ranking import share_of_group, sorted_rows
from .events import HOURS, WEEK_GRID, customer_events


def _counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def weekday_hour_share(fact, time_of_day, as_of=None, days: int = 45, labels: str = "danish") -> DataFrame:
    """Hour profile of each weekday, in percent of the weekday's events."""
    counts = _counts(customer_events(fact, time_of_day, as_of, days), "weekday", "hour")
    full = densify(counts, [], WEEK_GRID, "n")
    shares = share_of_group(full, ["weekday"], "n", "share_pct", scale=100.0)
    return shares.select(
        "weekday", weekday_label(F.col("weekday"), labels).alias("weekday_label"), "hour", "share_pct"
    )


def weekday_hour_heatmap(fact, time_of_day, as_of=None, days: int = 45) -> DataFrame:
    """Events of all customers by weekday and hour."""
    counts = _counts(customer_events(fact, time_of_day, as_of, days), "weekday", "hour")
    full = densify(counts, [], WEEK_GRID, "n")
    return full.withColumn("log_n", log_intensity(F.col("n")))


def customer_weekday_hour_heatmap(
    fact, time_of_day, customers: Iterable[int] | None = None, as_of=None, days: int = 45
) -> DataFrame:
    """The week of each customer; a list of customers limits the table."""
    events = customer_events(_only(fact, customers), time_of_day, as_of, days)
    full = densify(_counts(events, "customer_key", "weekday", "hour"), ["customer_key"], WEEK_GRID, "n")
    return full.withColumn("log_n", log_intensity(F.col("n")))


def customer_hour_heatmap(
    fact, time_of_day, customers: Iterable[int] | None = None, as_of=None, days: int = 45
) -> DataFrame:
    """The day of each customer."""
    events = customer_events(_only(fact, customers), time_of_day, as_of, days)
    full = densify(_counts(events, "customer_key", "hour"), ["customer_key"], {"hour": HOURS}, "n")
    return full.withColumn("log_n", log_intensity(F.col("n")))


def _only(fact: DataFrame, customers: Iterable[int] | None) -> DataFrame:
    return fact if customers is None else fact.where(F.col("customer_key").isin(list(customers)))


def category_weekday_hour_heatmap(themed_week: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """Weekday and hour counts per category group, all cells present.

    Rows with a null in day, time or group are left out. A group that loses all its rows this
    way keeps a grid of zeros unless ``keep_emptied`` is off.
    """
    known = themed_week.select("category_group", "weekday", "hour", "n").dropna("any")
    groups = None
    if keep_emptied:
        groups = themed_week.where(F.col("category_group").isNotNull()).select("category_group")
    return densify(_summed(known, "category_group", "weekday", "hour"), ["category_group"], WEEK_GRID, "n", domain=groups)


def single_category_heatmap(themed_week: DataFrame, group: str) -> DataFrame:
    """Observed weekday and hour cells of one category group."""
    chosen = themed_week.where(F.col("category_group") == group)
    return _summed(chosen, "category_group", "weekday", "hour")


def category_frequencies(themed_week: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first."""
    return sorted_rows(_summed(themed_week, column), "-n", column)


def all_category_frequencies(
    themed_week: DataFrame,
    columns: Sequence[str] = ("level1_danish", "name_english", "category_group", "category"),
) -> DataFrame:
    """Frequencies of several columns in one table, in one pass over the events."""
    combined = _summed(themed_week, *columns)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    return _summed(combined.select("n", F.inline(F.array(*cells))), "column", "value")


def product_time_profile(themed_events: DataFrame, product: int) -> DataFrame:
    """Counts per second of the day for one product."""
    return _counts(themed_events.where(F.col("product_key") == product), "secs")


def column_cardinalities(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values of every column, null counted as one; ``approximate`` estimates them in one pass by sketches."""
    if approximate:
        return sketches.distinct_counts(sketches.distinct_sketches(df, [], df.columns), [], df.columns)
    return df.agg(*[count_distinct(F.col(c)).alias(c) for c in df.columns])
