"""Top-k with ties, first row per key, row numbers and quantile buckets without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.semantics import null_last
from ..session import cut_lineage


def top_with_ties(df: DataFrame, keys: Sequence[str], metric: str, k: int = 1) -> DataFrame:
    """Rows of rank k or better within their group, ties included.

    The rank limit is applied before the shuffle as well as after it, so a group with very many
    rows sends only its leaders.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc())
    ranked = df.where(F.col(metric).isNotNull()).withColumn("_rank", F.rank().over(w))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def top_n_with_ties(df: DataFrame, metric: str, n: int) -> DataFrame:
    """The n largest rows of the whole table, and whatever ties with the last of them.

    The n-th value comes from a distributed top-n and becomes a scalar the scan filters with.
    """
    leaders = df.where(F.col(metric).isNotNull()).select(metric).orderBy(F.col(metric).desc()).limit(n)
    return df.where(F.col(metric) >= leaders.agg(F.min(metric)).scalar())


def last_rows(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """The last n rows of an ordering, as a distributed top-n."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sorted_rows(df: DataFrame, *order: str) -> DataFrame:
    """Sort by columns, '-name' for descending; nulls last either way."""
    keys = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    return df.orderBy(*keys)


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One whole row per key: the smallest in column order, nulls last.

    Spark sorts each task's rows by key for this aggregate and keeps one per key before the shuffle, so
    a key with very many rows is one row per task there.
    """
    rest = [c for c in df.columns if c not in keys]
    order = list(order or rest)
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(row, null_last(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number", total: str = "row_count") -> DataFrame:
    """Global 1-based row numbers and the row count, without one task that sees every row.

    Rows are range-partitioned and sorted; a row's number is its position in its partition plus
    the rows of the partitions before. Only one row per partition enters the running total.
    ``order`` should identify rows, else the order within ties is arbitrary.
    The sorted rows are materialised once, so positions and totals describe the same partitions.
    """
    placed = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    partition, position = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(partition.alias("_part")).agg(F.count("*").alias("_size"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(everything).alias(total),
    )
    return (
        placed.withColumn("_part", partition)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_part", "_place", "_before")
    )


def bucket_of_rank(rank: Column, total: Column, buckets: int) -> Column:
    """Equal-size bucket of a 1-based rank; the first buckets take the remainder."""
    div = lambda a, b: F.call_function("div", a, b)
    size, extra = div(total, F.lit(buckets)), total % buckets
    wide = extra * (size + 1)
    late = div(rank - 1 - wide, F.greatest(size, F.lit(1))) + extra + 1
    return F.when(rank <= wide, div(rank - 1, size + 1) + 1).otherwise(late).cast("int")


def quantile_bucket(df: DataFrame, value: str, buckets: int, ties: Sequence[str], name: str = "bucket") -> DataFrame:
    """Bucket 1..n of each row by ``value`` over the whole table; a null value has a null bucket."""
    known = number_rows(df.where(F.col(value).isNotNull()), [value, *ties], "_rank", "_total")
    known = known.withColumn(name, bucket_of_rank(F.col("_rank"), F.col("_total"), buckets))
    unknown = df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("int"))
    return known.drop("_rank", "_total").unionByName(unknown)


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row") -> DataFrame:
    """Row numbers inside small groups."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def flag_gaps(df: DataFrame, keys: Sequence[str], position: str, name: str = "gap") -> DataFrame:
    """'1' where a position follows the one before it directly, 'gap' where not, null at the start.

    Rows of equal position share their predecessor, the largest smaller position. Collapse
    repeats first, so that the positions bound the group.
    """
    earlier = Window.partitionBy(*keys).orderBy(position).rangeBetween(Window.unboundedPreceding, -1)
    before = F.max(position).over(earlier)
    flag = F.when(before.isNull(), F.lit(None).cast("string"))
    return df.withColumn(name, flag.when(F.col(position) != before + 1, "gap").otherwise("1"))


def share_of_group(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "share", scale: float = 1.0, total: str | None = None
) -> DataFrame:
    """Value as a part of its group's total, times ``scale``; null where the total is zero."""
    group_total = F.sum(value).over(Window.partitionBy(*keys))
    share = F.try_divide(F.col(value).cast("double"), group_total.cast("double")) * scale
    out = df.withColumn(name, share)
    return out if total is None else out.withColumn(total, group_total)
