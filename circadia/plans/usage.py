"""How much is consumed? Daily totals and averages, members and their two periods."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import date_of_key, days_before, key_of_date
from ..functions.clock import minutes, whole_minutes
from ..operators import sketches
from ..operators.joins import null_safe_join
from ..operators.ranking import sorted_rows, top_n_with_ties
from ..operators.stats import exact_median
from ..session import cut_lineage


def clean_durations(durations: DataFrame, as_of=None, settle_days: int = 3) -> DataFrame:
    """Typed durations of known customers, without the last days, which are still filling.

    The limit is also stated on the stored key, where the scan can use it.
    """
    limit = days_before(as_of, settle_days)
    key, date = F.col("read_duration_date_key"), date_of_key(F.col("read_duration_date_key"))
    return (
        durations.where((key < key_of_date(limit)) & (F.col("customer_key") > 0) & date.isNotNull())
        .select(date.alias("date"), "customer_key", "product_key", F.col("milliseconds_spent").cast("double").alias("msec"))
    )


def per_customer_day(clean: DataFrame, distinct_titles: bool = False) -> DataFrame:
    """Time and rows per day and customer: the level the daily averages build on."""
    titles = F.count_distinct("product_key") if distinct_titles else F.count("*")
    return clean.groupBy("date", "customer_key").agg(F.sum("msec").alias("msec"), titles.alias("titles"))


def daily_consumption(clean: DataFrame) -> DataFrame:
    """Total time, users and average time per user of each day.

    Users are counted on the customer-day level, so a busy day is spread over its customers.
    """
    days = clean.groupBy("date", "customer_key").agg(F.sum("msec").alias("msec")).groupBy("date").agg(
        F.sum("msec").alias("time"), F.count("*").alias("users")
    )
    msec = F.col("time") / F.col("users")
    return days.withColumns({
        "avg_time_msec": msec, "avg_time_secs": msec / 1000, "avg_time_mins": minutes(msec)
    })


def daily_customer_minutes(clean: DataFrame, approximate: bool = False) -> DataFrame:
    """Median and mean minutes per customer, by day; ``approximate`` takes the median from a sketch per day."""
    spent = clean.groupBy("date", "customer_key").agg(minutes(F.sum("msec")).alias("t"))
    means = spent.groupBy("date").agg(F.avg("t").alias("mean"))
    middle = sketches.medians(spent, ["date"], "t") if approximate else exact_median(spent, ["date"], "t")
    return null_safe_join(middle, means, ["date"])


def daily_titles_per_customer(clean: DataFrame, distinct_titles: bool = False) -> DataFrame:
    """Mean number of reading rows (or distinct titles) per customer, by day."""
    return per_customer_day(clean, distinct_titles).groupBy("date").agg(F.avg("titles").alias("m"))


def average_daily_minutes(clean: DataFrame) -> DataFrame:
    """Mean of the daily totals, in minutes."""
    daily = clean.groupBy("date").agg(minutes(F.sum("msec")).alias("time"))
    return daily.agg(F.avg("time").alias("avg_time"))


def _usage_since(members: DataFrame, reads: DataFrame, durations: DataFrame, periods: Mapping[str, int]) -> DataFrame:
    """Per member with the benefit: buckets read, whole minutes and duration rows since each period's calendar key.

    Both facts are read once for all periods and shrink to one row per customer before they meet the members.
    """
    entitled = members.where(F.col("streaming_benefit") == "Yes").select("customer_key", "email")
    first, read, spent_on = min(periods.values()), F.col("date_key"), F.col("read_duration_date_key")
    buckets = reads.where(read >= first).groupBy("customer_key").agg(
        *[F.count_if(read >= since).alias(f"n_buckets{name}") for name, since in periods.items()]
    )
    totals = []
    for name, since in periods.items():
        inside = spent_on >= since
        totals.append(F.sum(F.when(inside, whole_minutes(F.col("milliseconds_spent")))).alias(f"total_minutes{name}"))
        totals.append(F.count_if(inside).alias(f"_durations{name}"))
    spent = durations.where(spent_on >= first).groupBy("customer_key").agg(*totals)
    return entitled.join(buckets, "customer_key").join(spent, "customer_key").drop("customer_key")


def _of_period(usage: DataFrame, name: str) -> DataFrame:
    """Members with rows in both facts in the period."""
    both = (F.col(f"n_buckets{name}") > 0) & (F.col(f"_durations{name}") > 0)
    return usage.where(both).select("email", f"n_buckets{name}", f"total_minutes{name}")


def member_usage(
    members: DataFrame, reads: DataFrame, durations: DataFrame, since: int, suffix: str = ""
) -> DataFrame:
    """Buckets read and whole minutes spent since a calendar key, per member with the benefit and rows in both facts."""
    return _of_period(_usage_since(members, reads, durations, {suffix: since}), suffix)


def top_members(
    members: DataFrame,
    reads: DataFrame,
    durations: DataFrame,
    since_recent: int,
    since_start: int,
    n: int = 1000,
    rank_by: str = "total_minutes_ytd",
) -> DataFrame:
    """Members of both periods, the n strongest with ties, most recent buckets first.

    Both periods come from one pass over each fact, whose result (a row per member) is stored: the periods meet
    by address, and the threshold of the ranking reads them again.
    """
    usage = cut_lineage(_usage_since(members, reads, durations, {"_recent": since_recent, "_ytd": since_start}))
    joined = null_safe_join(_of_period(usage, "_recent"), _of_period(usage, "_ytd"), ["email"])
    return sorted_rows(top_n_with_ties(joined, rank_by, n), "-n_buckets_recent", "email")
