"""Column standardisation and equal-width bins from one pass of statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """z-scores; nulls are skipped by the statistics and stay null, a constant column gives 0.

    One aggregate row feeds the projection as a scalar, so nothing is joined or collected.
    """
    found = df.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    )).scalar()
    # one column for all of them: a subquery per use would be planned once per use
    stats, scaled = F.col("_stats"), {}
    for c in columns:
        centred = F.col(c).cast("double") - stats[f"m_{c}"]
        flat = F.when(F.col(c).isNotNull(), F.lit(0.0))
        scaled[f"{c}{suffix}"] = F.when(stats[f"s_{c}"] > 0, centred / stats[f"s_{c}"]).otherwise(flat)
    return df.withColumn("_stats", found).withColumns(scaled).drop("_stats")


def interval_bin(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """0-based equal-width bin over the range of an integer column.

    Bins are closed on the right, the first one on both sides; integer arithmetic keeps values on
    an edge in the bin the edge belongs to.
    """
    bounds = df.agg(F.struct(
        F.min(value).cast("bigint").alias("low"), (F.max(value) - F.min(value)).cast("bigint").alias("width")
    )).scalar()
    offset = (F.col(value).cast("bigint") - bounds["low"]) * bins
    width = F.greatest(bounds["width"], F.lit(1))
    number = F.call_function("div", offset + width - 1, width) - 1
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(number, F.lit(0)).cast("int")))
