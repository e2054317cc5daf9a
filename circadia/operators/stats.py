"""Medians, spreads and outlier rules that hold when one group has most of the rows.

Values with a small domain (seconds of a day) are counted first; a group then has at most
86,400 weighted rows, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .joins import null_safe_join

#: Groups whose statistics may be sent to all tasks.
FEW = 1000


def whole_numbers(df: DataFrame, value: str) -> None:
    """Raises unless the column is of an integer type: only then are a group's distinct values few."""
    kind = df.schema[value].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{value} must be of an integer type, not {kind.simpleString()}")


def rows_of(counted: str | None) -> Column:
    """How many rows a group has; of rows that stand for several, ``counted`` names how many."""
    return F.count("*") if counted is None else F.sum(counted)


def histogram(df: DataFrame, keys: Sequence[str], value: str, weight: str = "n", counted: str | None = None) -> DataFrame:
    """Rows per key and value."""
    return df.groupBy(*keys, value).agg(rows_of(counted).alias(weight))


def weighted_sd(value: Column, weight: Column, over=None) -> Column:
    """Sample standard deviation of integer values with counts; null for a single observation.

    The sums are exact decimals, so the result does not depend on the order of rows. ``over``
    turns it into a window expression.
    """
    exact = "decimal(38,0)"
    total = lambda c: F.sum(c) if over is None else F.sum(c).over(over)
    w = F.when(value.isNotNull(), weight)
    n, s1 = total(w).cast(exact), total(w * value).cast(exact)
    s2 = total((w * value).cast("decimal(19,0)") * value.cast("decimal(10,0)")).cast(exact)
    spread = (n * s2 - s1 * s1).cast("double")
    pairs = n.cast("double") * (n.cast("double") - 1)
    return F.when(n > 1, F.sqrt(spread / pairs))


def known_or_null(result: Column, value: Column, unknown: str, over=None) -> Column:
    """A statistic under one of two rules for missing values.

    ``skip`` leaves them out; ``propagate`` makes the statistic of their group null.
    """
    if unknown == "skip":
        return result
    if unknown == "propagate":
        missing = F.max(value.isNull())
        return F.when(~(missing if over is None else missing.over(over)), result)
    raise ValueError(f"unknown rule for missing values {unknown!r}")


def weighted_quantile(value: str, weight: str, q: float) -> Column:
    """Quantile of values with counts, interpolated between neighbours."""
    return F.percentile(F.col(value), F.lit(q), F.col(weight))


def summarise(hist: DataFrame, keys: Sequence[str], value: str, weight: str = "n", *extra: Column) -> DataFrame:
    """Count, median, quartile distance, extremes and spread per group of a histogram."""
    v, w = F.col(value), F.col(weight)
    return hist.groupBy(*keys).agg(
        F.sum(w).alias("n_rows"),
        weighted_quantile(value, weight, 0.5).alias("median"),
        (weighted_quantile(value, weight, 0.75) - weighted_quantile(value, weight, 0.25)).alias("iqr"),
        weighted_sd(v, w).alias("sd"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        *extra,
    )


def median_and_sd(
    hist: DataFrame, keys: Sequence[str], value: str, weight: str = "n", unknown: str = "skip"
) -> DataFrame:
    v = F.col(value)
    return hist.groupBy(*keys).agg(
        known_or_null(weighted_quantile(value, weight, 0.5), v, unknown).alias("median"),
        known_or_null(weighted_sd(v, F.col(weight)), v, unknown).alias("sd"),
    )


def keeps(value: Column, median: Column, sd: Column, rule: str, width: float = 2.0) -> Column:
    """Outlier predicate.

    ``not_beyond`` keeps values at distance width x sd or less, also when sd is zero;
    ``within`` wants a smaller distance, so a group without spread loses its rows.
    An unknown sd (one observation) keeps nothing under either rule.
    """
    distance = F.abs(value - median)
    if rule == "not_beyond":
        return ~(distance > width * sd)
    if rule == "within":
        return distance < width * sd
    raise ValueError(f"unknown outlier rule {rule!r}")


def drop_outliers(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rule: str,
    width: float = 2.0,
    unknown: str = "skip",
    few_groups: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """Rows that pass the outlier rule of their group; statistics are over the whole group.

    ``approximate`` takes the median from a sketch (see ``sketches``): no value is counted, the spread stays exact.

    ``few_groups`` is for keys of a small domain, such as weekdays: if there are at most ``FEW`` groups,
    their statistics are sent to the rows, which need no shuffle; else rows and statistics are joined.
    """
    if approximate:
        from . import sketches

        if unknown != "skip":
            raise ValueError("sketches leave unknown values out")
        stats = sketches.median_and_sd(df, keys, value)
    else:
        stats = median_and_sd(histogram(df, keys, value), keys, value, unknown=unknown)
    if few_groups and df.select(*keys).distinct().limit(FEW + 1).count() <= FEW:
        stats = F.broadcast(stats)
    joined = null_safe_join(df, stats, keys)
    kept = joined.where(keeps(F.col(value), F.col("median"), F.col("sd"), rule, width))
    return kept.select(*df.columns)


def modal(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode", counted: str | None = None) -> DataFrame:
    """Most frequent known value per group, the smallest on a tie; null where none is known.

    Rows are counted per key and value first, so what is compared is one row per value.
    """
    counts = histogram(df, keys, value, "_n", counted)
    rank = F.when(F.col(value).isNotNull(), F.struct(-F.col("_n"), F.col(value)))
    return counts.groupBy(*keys).agg(F.min_by(value, rank).alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group, as a double, for any orderable type and any number of distinct values.

    Rows are counted per key and value and put in order by key and value in ranges, so a key with very
    many values is several ranges. A value's rank is the count before it in its range plus what the key
    has in earlier ranges, of which there is one total per range. The one or two middle values are then
    picked. A group whose values are all null has a null median.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_rows"))
    counted = counted.withColumn("_n", F.when(F.col(value).isNull(), 0).otherwise(F.col("_rows")))
    ranged = counted.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    placed = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range", *keys).agg(F.sum("_n").alias("_here"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *keys,
        F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_here").over(Window.partitionBy(*keys)).alias("_all"),
    )
    upto = Window.partitionBy("_range", *keys).orderBy(F.col(value).asc_nulls_first())
    ranked = null_safe_join(placed, offsets, ["_range", *keys])
    ranked = ranked.withColumn("_last", F.col("_before") + F.sum("_n").over(upto))
    at = lambda rank: F.max(
        F.when((F.col("_last") - F.col("_n") < rank) & (rank <= F.col("_last")), F.col(value).cast("double"))
    )
    low, high = at(F.floor((F.col("_all") + 1) / 2)), at(F.floor(F.col("_all") / 2) + 1)
    middle = ranked.groupBy(*keys).agg(low.alias("_a"), high.alias("_z"))
    median = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise((F.col("_a") + F.col("_z")) / 2)
    return middle.select(*keys, median.alias(name))
