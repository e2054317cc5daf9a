"""Each customer's habit: modal day and hour, weekend share, median time, typical slot.

Events are counted per customer, weekday and hour (or second) before a customer's rows meet, so
a customer brings at most 7 x 24 (or 7 x 86,400) rows, however many events there are. ``counted``
names the weight of rows that are counts already (see ``rhythm``); they are laid out by customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import WEEKDAY_LABELS, weekday_label, weekend_flag
from ..functions.semantics import null_last
from ..operators.grid import pivot_values
from ..operators.joins import full_join_all, null_safe_join
from ..operators.ranking import top_with_ties
from ..operators.stats import histogram, keeps, known_or_null, rows_of, weighted_quantile, weighted_sd

KEY = "customer_key"


def week_counts(events: DataFrame, counted: str | None = None) -> DataFrame:
    """Events per customer, weekday and hour; the modal tables and the weekend share roll it up.

    Laid out by customer once, so none of the roll-ups and joins on top shuffles again.
    """
    counts = events.groupBy(KEY, "weekday", "hour").agg(rows_of(counted).alias("n"))
    return counts.repartition(KEY) if counted is None else counts


def _rolled(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(KEY, *by).agg(F.sum("n").alias("n"))


def modal_weekday(counts: DataFrame) -> DataFrame:
    """Most frequent weekday(s) of each customer."""
    top = top_with_ties(_rolled(counts, "weekday"), [KEY], "n")
    return top.select(KEY, weekday_label(F.col("weekday"), "short").alias("weekday_name"))


def modal_hour(counts: DataFrame) -> DataFrame:
    """Most frequent hour(s) of each customer; an unknown time counts as an hour of its own."""
    return top_with_ties(_rolled(counts, "hour"), [KEY], "n").select(KEY, "hour")


def modal_slot(counts: DataFrame) -> DataFrame:
    """Most frequent combination(s) of weekday and hour."""
    top = top_with_ties(counts, [KEY], "n")
    return top.select(
        KEY, weekday_label(F.col("weekday"), "short").alias("day_combined"), F.col("hour").alias("hour_combined")
    )


def weekend_ratio(counts: DataFrame) -> DataFrame:
    """Share of a customer's events on Saturday and Sunday."""
    flagged = counts.withColumn("weekend", weekend_flag(F.col("weekday")))
    sums = flagged.groupBy(KEY, "weekend").agg(F.sum("n").alias("n"))
    wide = pivot_values(sums, [KEY], "weekend", ["no", "yes"], "n", fill=0)
    ratio = F.try_divide(F.col("yes").cast("double"), (F.col("no") + F.col("yes")).cast("double"))
    return wide.select(KEY, ratio.alias("weekend_ratio"))


def median_time(events: DataFrame, unknown: str = "skip", counted: str | None = None) -> DataFrame:
    """Median second of the day; null where no time is known (or not all, under ``propagate``)."""
    seconds = histogram(events, [KEY], "secs", counted=counted)
    median = known_or_null(weighted_quantile("secs", "n", 0.5), F.col("secs"), unknown)
    return seconds.groupBy(KEY).agg(median.alias("median_secs"))


def _most_frequent(sums: dict[str, Column]) -> Column:
    """Name with the largest sum; the first in order on a tie, the unnamed one last."""
    options = [
        F.struct(-total, F.lit(name is None).alias("unnamed"), F.lit(name).alias("name"))
        for name, total in sums.items()
    ]
    return F.array_min(F.array(*options))["name"]


def habit_profile(events: DataFrame, counted: str | None = None) -> DataFrame:
    """One row per customer with all five habits.

    Ties are settled within each habit (alphabetical day, earliest hour), which gives the row
    that settling them after joining the tied tables would give. The four counted habits come
    from one aggregate over the customer's week, only the median reads the events again.
    """
    counts = week_counts(events, counted)
    n, weekday, hour = F.col("n"), F.col("weekday"), F.col("hour")
    label = weekday_label(weekday, "short")
    total = lambda hit: F.sum(F.when(hit, n).otherwise(0))
    names = {f"_d{i}": name for i, name in enumerate(WEEKDAY_LABELS["short"], start=1)}
    day_sums = {f"_d{i}": total(weekday == i) for i in range(1, 8)} | {"_d": total(weekday.isNull())}
    hour_sums = {f"_h{i}": total(hour == i) for i in range(24)} | {"_h": total(hour.isNull())}
    slot = F.min_by(F.struct(label.alias("day"), hour.alias("hour")), F.struct(-n, null_last(label, hour)))
    sums = counts.groupBy(KEY).agg(
        *[s.alias(c) for c, s in (day_sums | hour_sums).items()], F.sum("n").alias("_all"), slot.alias("_slot")
    )
    days = {names.get(c): F.col(c) for c in day_sums}
    hours = {int(c[2:]) if c[2:] else None: F.col(c) for c in hour_sums}
    weekend = F.col("_d6") + F.col("_d7")
    counts_row = sums.select(
        KEY,
        _most_frequent(days).alias("weekday_name"),
        _most_frequent(hours).cast("int").alias("hour"),
        F.col("_slot.day").alias("day_combined"),
        F.col("_slot.hour").alias("hour_combined"),
        F.try_divide(weekend.cast("double"), (F.col("_all") - F.col("_d")).cast("double")).alias("weekend_ratio"),
    )
    return full_join_all([counts_row, median_time(events, counted=counted)], [KEY])


def typical_slot(events: DataFrame, unknown: str = "skip", counted: str | None = None) -> DataFrame:
    """Modal weekday and the median time on it, outliers left out.

    The outlier limits use all of a customer's events, not only those of the modal day. One
    shuffle by customer serves the limits, the mode and the final median.
    """
    slots = histogram(events, [KEY, "weekday"], "secs", counted=counted)
    whole, day = Window.partitionBy(KEY), Window.partitionBy(KEY, "weekday")
    secs, n = F.col("secs"), F.col("n")
    placed = slots.withColumns({
        "median": known_or_null(weighted_quantile("secs", "n", 0.5).over(whole), secs, unknown, whole),
        "sd": known_or_null(weighted_sd(secs, n, whole), secs, unknown, whole),
        "day_n": F.sum("n").over(day),
    })
    best = F.min_by("weekday", F.struct(-F.col("day_n"), null_last(F.col("weekday")))).over(whole)
    kept = placed.withColumn("modal_weekday", best).where(
        (F.col("weekday") == F.col("modal_weekday")) & keeps(secs, F.col("median"), F.col("sd"), "within")
    )
    return kept.groupBy(KEY, "modal_weekday").agg(weighted_quantile("secs", "n", 0.5).alias("median_secs"))


def weekday_start_time(events: DataFrame, margin: int = 5 * 60, unknown: str = "skip") -> DataFrame:
    """Events that are no outliers on their weekday, with the weekday's usual start.

    ``start_secs`` is the earliest kept time minus a margin; ``is_modal_day`` marks the weekday
    with the most kept events. Limits, starts and mode come from one count per weekday and
    second, so the seven huge groups are never sorted; the events meet a table of eight rows.
    """
    counts = histogram(events, ["weekday"], "secs")
    secs, median, sd = F.col("secs"), F.col("median"), F.col("sd")
    day = Window.partitionBy("weekday")
    limits = {
        "median": known_or_null(weighted_quantile("secs", "n", 0.5).over(day), secs, unknown, day),
        "sd": known_or_null(weighted_sd(secs, F.col("n"), day), secs, unknown, day),
    }
    days = counts.withColumns(limits).where(keeps(secs, median, sd, "not_beyond")).groupBy("weekday").agg(
        F.first("median").alias("median"),
        F.first("sd").alias("sd"),
        (F.min("secs") - margin).alias("start_secs"),
        F.sum("n").alias("day_n"),
    )
    week = Window.partitionBy(F.lit(0))
    best = F.min_by("weekday", F.struct(-F.col("day_n"), null_last(F.col("weekday")))).over(week)
    days = days.withColumn("is_modal_day", F.col("weekday").eqNullSafe(best)).drop("day_n")
    # At most eight rows, seven weekdays and unknown: the hint spares the events a shuffle.
    return (
        null_safe_join(events, F.broadcast(days), ["weekday"])
        .where(keeps(secs, median, sd, "not_beyond"))
        .select(KEY, "weekday", "secs", "start_secs", "is_modal_day")
    )
