"""Opt-in approximate distinct counts and medians from sketches that can be stored and merged.

A sketch per day (or any other cell) is kept and cells are merged when a longer period is asked for, so a
dashboard over many days reads a few kilobytes a day instead of the events. Sketches merge map-side: a key with most of
the rows is one sketch per task before anything is shuffled.

Distinct counts: HyperLogLog with 2**``LG_K`` registers, relative error ``distinct_error()``, three standard deviations.
Medians: KLL with parameter ``QUANTILE_K``; the *rank* of the result is within ``RANK_ERROR`` of one half (99 % of the
time). KLL draws random bits, so two runs can differ inside that error; HyperLogLog does not depend on order or layout.

Nulls take no part in a sketch. That one occurred is kept beside a distinct sketch, because a null counts as one more value
by this library's rule (``count_null``). A cell without known values has a distinct count of 0 and a null median.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .stats import weighted_sd

LG_K = 12
QUANTILE_K = 1000
RANK_ERROR = 0.01

_AS_THEY_ARE = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard deviations of the relative error."""
    return 3 * 1.04 / sqrt(1 << lg_k)


def _hashable(df: DataFrame, column: str) -> Column:
    """Integers and text as they are, other types by their text."""
    return F.col(column) if isinstance(df.schema[column].dataType, _AS_THEY_ARE) else F.col(column).cast("string")


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Per key and column a sketch of the known values (``c_values``) and whether a null occurred (``c_null``)."""
    parts = []
    for c in columns:
        parts += [F.hll_sketch_agg(_hashable(df, c), lg_k).alias(f"{c}_values"), F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"{c}_null")]
    return df.groupBy(*keys).agg(*parts)


def merged_distinct(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sketches of larger cells from those of smaller ones."""
    parts = []
    for c in columns:
        parts += [F.hll_union_agg(f"{c}_values").alias(f"{c}_values"), F.coalesce(F.bool_or(f"{c}_null"), F.lit(False)).alias(f"{c}_null")]
    return sketches.groupBy(*keys).agg(*parts)


def distinct_counts(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], count_null: bool = True) -> DataFrame:
    """The estimated number of distinct values per key, one column each."""
    def estimate(c: str) -> Column:
        known = F.coalesce(F.hll_sketch_estimate(f"{c}_values"), F.lit(0))
        return (known + F.col(f"{c}_null").cast("int") if count_null else known).cast("long").alias(c)

    return sketches.select(*keys, *[estimate(c) for c in columns])


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """Per key a sketch of the known values (``value_quantiles``), as doubles, and their number (``n``)."""
    known = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(known, k).alias(f"{value}_quantiles"), F.count(value).alias("n"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """Sketches of larger cells from those of smaller ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double(f"{value}_quantiles", k).alias(f"{value}_quantiles"), F.sum("n").alias("n"))


def quantile(value: str, q: float = 0.5) -> Column:
    """The estimated quantile of a sketch; null where nothing is known."""
    # an empty sketch has no quantiles to ask for
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(f"{value}_quantiles", F.lit(q)))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", k: int = QUANTILE_K) -> DataFrame:
    """Estimated median per group in one aggregation."""
    return quantile_sketches(df, keys, value, k).select(*keys, quantile(value).alias(name))


def median_and_sd(df: DataFrame, keys: Sequence[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """Estimated median and exact spread of whole numbers per group, in one aggregation over the rows."""
    known = F.col(value)
    sketched = df.groupBy(*keys).agg(
        F.kll_sketch_agg_double(known.cast("double"), k).alias(f"{value}_quantiles"),
        F.count(value).alias("n"),
        weighted_sd(known, F.lit(1).cast("long")).alias("sd"),
    )
    return sketched.select(*keys, quantile(value).alias("median"), "sd")
