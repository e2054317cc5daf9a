"""When each customer reads, counted once a day and stored: what habits, slots, regularity, shares and peaks read.

A day's events become one row per customer and second, so a customer has at most 86,401 rows a day. A new or
corrected day replaces its own counts; days that leave the look-back are not read. The table is bucketed by customer:
the analyses take ``window``, with ``counted="n"``, and group and sort inside the buckets without a shuffle.

The unknown customer is stored like any other (and bounded like any other); an unknown time is a null second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import date_of_key, iso_weekday, weekday_label
from ..functions.clock import hour_of
from ..sources.layout import Layout
from .events import clock_dimension, known_customers, recent

KEY = "customer_key"


def layout(path: str, buckets: int, key_type: str = "bigint") -> Layout:
    """The stored table; buckets are the tasks of a read, so their number is sized to the look-back window."""
    return Layout(path, f"{KEY} {key_type}, secs INT, n BIGINT", "date_key", KEY, buckets)


def daily_counts(fact: DataFrame, time_of_day: DataFrame) -> DataFrame:
    """Events per day, customer and second; counted per time key before the clock is looked up."""
    keys = fact.groupBy("date_key", KEY, "time_of_day_key").agg(F.count("*").alias("n"))
    placed = keys.join(clock_dimension(time_of_day), "time_of_day_key", "left")
    return placed.groupBy("date_key", KEY, "secs").agg(F.sum("n").alias("n"))


def store(
    spark: SparkSession, fact: DataFrame, time_of_day: DataFrame, where: Layout, table: str | None = None,
    days: Sequence[int] | None = None,
) -> str:
    """Counts and stores the fact's days (or the named ones), registering the table first if it has no name yet."""
    name = table or where.register(spark)
    if days is not None:
        fact = fact.where(F.col("date_key").isin(sorted(set(days))))
    where.replace_days(name, daily_counts(fact, time_of_day), days)
    return name


def window(spark: SparkSession, table: str, as_of=None, days: int | None = 45, known: bool = True) -> DataFrame:
    """Counts ``n`` per customer, weekday and second over the look-back window, as events with a weight.

    Has ``weekday``, ``week_day`` (its name) and ``hour`` as the events of the analyses have.
    """
    rows = recent(spark.table(table), as_of, days)
    if known:
        rows = known_customers(rows)
    weekly = rows.withColumn("weekday", iso_weekday(date_of_key(F.col("date_key"))))
    summed = weekly.groupBy(KEY, "weekday", "secs").agg(F.sum("n").alias("n"))
    return summed.select(
        KEY, "weekday", weekday_label(F.col("weekday")).alias("week_day"), "secs", hour_of(F.col("secs")).alias("hour"), "n"
    )
