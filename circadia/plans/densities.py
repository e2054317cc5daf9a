"""Densities of time of day, and where they peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import clock_text, seconds_of_timestamp
from ..functions.text import peak_label, remove_first
from ..operators.density import density, peak


def game_starts(events: DataFrame, event_name: str = "gameStarted") -> DataFrame:
    """Starts with their second of the day."""
    starts = events.where(F.col("event_name") == event_name)
    return starts.select("event_timestamp", "user_country", seconds_of_timestamp(F.col("event_timestamp")).alias("secs"))


def start_time_density(starts: DataFrame, points: int = 512) -> DataFrame:
    """Density of all starts over the day."""
    return density(starts, "secs", points=points)


def start_time_peak(starts: DataFrame, points: int = 512) -> DataFrame:
    """Busiest second, as number, clock text and label."""
    top = peak(density(starts, "secs", points=points))
    secs = F.rint("x").cast("int")
    return top.select(secs.alias("peak_secs"), clock_text(secs).alias("peak_time"), peak_label(secs).alias("label"))


def counted_by_country(countries: DataFrame, starts: DataFrame) -> DataFrame:
    """Each listed country with its starts per second, counted (n) before they meet the countries.

    A country without any stays, with nulls. The countries' side of the join has at most 86,400 rows
    each, whatever their events.
    """
    counts = starts.groupBy("user_country", "secs").agg(F.count("*").alias("n"))
    return countries.join(counts, "user_country", "left")


def starts_by_country(countries: DataFrame, starts: DataFrame) -> DataFrame:
    """Each listed country with its starts, one row per start; a country without any stays, with nulls."""
    counted = counted_by_country(countries, starts)
    times = F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long")))
    return counted.withColumn("_time", F.explode(times)).drop("_time", "n")


def country_time_density(countries, starts, exclude: Sequence[str] = (), points: int = 512) -> DataFrame:
    """One curve per region on a common grid, optionally without some countries."""
    joined = counted_by_country(countries, starts)
    for country in exclude:
        joined = joined.where(F.col("user_country") != country)
    return density(joined, "secs", ["region"], shared=True, points=points, min_rows=3, weight="n")


def category_time_density(themed_events: DataFrame, prefix: str = r"Bøger\|", points: int = 512) -> DataFrame:
    """One curve per top-level category, its common prefix removed."""
    known = themed_events.select("date_key", "secs", "level1_danish").dropna("any")
    named = known.withColumn("category", remove_first(F.col("level1_danish"), prefix))
    return density(named, "secs", ["category"], shared=True, points=points, min_rows=3)


def customer_time_density(events: DataFrame, points: int = 512) -> DataFrame:
    """One curve per customer."""
    return density(events, "secs", ["customer_key"], shared=True, points=points, min_rows=3)
