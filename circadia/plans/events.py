"""Reading events with their weekday, second of the day and category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import date_of_key, iso_weekday, weekday_label, within_days
from ..functions.clock import hour_of, seconds_of_text
from ..operators import joins, sampling

UNKNOWN = -1

HOURS = range(0, 24)
WEEKDAYS = range(1, 8)
WEEK_GRID = {"weekday": WEEKDAYS, "hour": HOURS}


def recent(fact: DataFrame, as_of=None, days: int | None = 45, since: int | None = None) -> DataFrame:
    """Rows of the look-back window, or from a fixed calendar key on."""
    if since is not None:
        return fact.where(F.col("date_key") >= since)
    return fact if days is None else fact.where(within_days(F.col("date_key"), as_of, days))


def known_customers(fact: DataFrame) -> DataFrame:
    """Without the unknown-customer member, by far the most frequent key of the fact."""
    return fact.where(F.col("customer_key") != UNKNOWN)


def clock_dimension(time_of_day: DataFrame) -> DataFrame:
    """Seconds per time key. Text is parsed here, on 86,400 rows, and not on every event."""
    return time_of_day.select("time_of_day_key", seconds_of_text(F.col("time_of_day")).alias("secs"))


def timed(fact: DataFrame, time_of_day: DataFrame, keep: Sequence[str] = ("customer_key",)) -> DataFrame:
    """Events with ``weekday`` (1 = Monday), ``secs`` and ``hour``; an unknown time stays null.

    A left join to a dimension of fixed size; Spark broadcasts it after its own size check.
    """
    return fact.join(clock_dimension(time_of_day), "time_of_day_key", "left").select(
        *keep,
        iso_weekday(date_of_key(F.col("date_key"))).alias("weekday"),
        "secs",
        hour_of(F.col("secs")).alias("hour"),
    )


def customer_events(fact: DataFrame, time_of_day: DataFrame, as_of=None, days: int | None = 45) -> DataFrame:
    """Timed events of known customers inside the look-back window."""
    return timed(known_customers(recent(fact, as_of, days)), time_of_day)


def segment_input(events: DataFrame) -> DataFrame:
    """Customer, second of the day and weekday name: the input of the segmentations."""
    return events.select("customer_key", "secs", weekday_label(F.col("weekday")).alias("week_day"))


def sample_events(
    fact: DataFrame, time_of_day: DataFrame, as_of=None, days: int = 45, n: int = 100, seed: int = 62
) -> DataFrame:
    """Distinct events of n randomly chosen customers."""
    columns = ("date_key", "customer_key", "time_of_day_key")
    scan = known_customers(recent(fact, as_of, days).select(*columns))
    chosen = sampling.sample_keys(scan, ["customer_key"], n, seed)
    # The sample cuts the rows before duplicates are looked for.
    events = joins.semi_on_keys(scan, chosen, ["customer_key"]).distinct()
    return timed(events, time_of_day, ("date_key", "customer_key"))


def themed(
    fact: DataFrame,
    bridge: DataFrame,
    categories: DataFrame,
    time_of_day: DataFrame,
    as_of=None,
    days: int = 7,
) -> DataFrame:
    """One row per event and category of its product; products without category stay.

    The unknown customer is part of this extract. Bridge and categories meet first: both are
    small next to the fact, which is then joined once.
    """
    named = bridge.join(categories, "thema_category_key", "left").withColumn("bridged_product_key", F.col("product_key"))
    events = recent(fact, as_of, days).select("date_key", "product_key", "time_of_day_key")
    return events.join(named, "product_key", "left").join(clock_dimension(time_of_day), "time_of_day_key", "left").select(
        "date_key",
        F.col("bridged_product_key").alias("product_key"),
        "secs",
        "thema_category_key",
        "level1_danish",
        "level1_english",
        "name_english",
        "category_group",
        "category",
    )


def themed_week(
    fact: DataFrame, bridge: DataFrame, categories: DataFrame, time_of_day: DataFrame, as_of=None, days: int = 7
) -> DataFrame:
    """How often (``n``) each category is read per product, weekday and hour.

    The same rows as :func:`themed`, counted per product before categories join, so neither a
    bestseller nor the unknown product carries its events through the fan-out.
    """
    events = timed(recent(fact, as_of, days), time_of_day, ("product_key",))
    counted = events.groupBy("product_key", "weekday", "hour").agg(F.count("*").alias("n"))
    named = bridge.join(categories, "thema_category_key", "left")
    return counted.join(named, "product_key", "left").drop("product_key")
