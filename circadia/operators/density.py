"""Gaussian densities of time of day, per group, on a fixed number of grid points."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .stats import histogram, summarise, whole_numbers
from ..session import spread

# Task code travels with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID_POINTS = 512
_CELLS_PER_STEP = 1 << 20


def kernel_sums(secs: np.ndarray, n: np.ndarray, bandwidth: float, grid: np.ndarray) -> np.ndarray:
    """Density of weighted points on a grid; memory stays bounded for long histograms."""
    out = np.empty(len(grid))
    step = max(1, _CELLS_PER_STEP // max(1, len(secs)))
    for start in range(0, len(grid), step):
        z = (grid[start:start + step, None] - secs[None, :]) / bandwidth
        out[start:start + step] = np.exp(-0.5 * z * z) @ n
    return out / (n.sum() * bandwidth * np.sqrt(2 * np.pi))


def _density_udf(points: int):
    @F.pandas_udf("array<double>")
    def densities(secs: pd.Series, n: pd.Series, bandwidth: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([
            kernel_sums(np.asarray(s, float), np.asarray(w, float), h, np.linspace(a, b, points))
            for s, w, h, a, b in zip(secs, n, bandwidth, low, high)
        ])

    return densities


def rule_of_thumb_bandwidth(n: Column, sd: Column, iqr: Column, low: Column) -> Column:
    """0.9 x the smaller of sd and iqr / 1.34, times n^(-1/5).

    Where that spread is zero the sd stands in, then the size of the value itself, then one.
    """
    spread = F.least(sd, iqr / 1.34)
    positive = lambda c: F.when(c > 0, c)
    scale = F.coalesce(positive(spread), positive(sd), positive(F.abs(low).cast("double")), F.lit(1.0))
    return F.when(n > 1, 0.9 * scale * F.pow(n.cast("double"), F.lit(-0.2)))


def density(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    shared: bool = False,
    points: int = GRID_POINTS,
    min_rows: int = 2,
    weight: str | None = None,
) -> DataFrame:
    """Density of ``value`` (integer seconds) on ``points`` grid points per group.

    Separate form: each group has its own bandwidth, the grid spans the range of all data.
    ``shared`` form (ridge plots): one bandwidth, the mean over groups, and one grid for all
    groups that reaches three bandwidths beyond the data.

    ``weight`` names a column of counts; without it each row counts once. The value must be of an
    integer type. Events are counted per second before anything is gathered, so the row a group becomes has at
    most 86,400 entries, and the work per group is bounded by those times the grid.
    """
    keys = list(keys)
    whole_numbers(df, value)
    known = df.where(F.col(value).isNotNull())
    hist = histogram(known, keys, value) if weight is None else known.groupBy(*keys, value).agg(F.sum(weight).alias("n"))
    pairs = F.collect_list(F.struct(F.col(value).alias("s"), F.col("n").alias("n")))
    groups = summarise(spread(hist, *keys) if keys else hist, keys, value, "n", pairs.alias("_pairs"))
    groups = groups.withColumn(
        "bandwidth", rule_of_thumb_bandwidth(F.col("n_rows"), F.col("sd"), F.col("iqr"), F.col("low"))
    )
    overall = groups.agg(
        F.struct(F.min("low").alias("low"), F.max("high").alias("high"), F.avg("bandwidth").alias("bandwidth"))
    ).scalar()
    if shared:
        width = overall["bandwidth"]
        low, high = overall["low"] - 3 * width, overall["high"] + 3 * width
    else:
        width, low, high = F.col("bandwidth"), overall["low"].cast("double"), overall["high"].cast("double")
    ready = groups.where(F.col("n_rows") >= min_rows).select(
        *keys,
        F.col("_pairs.s").alias("_s"),
        F.col("_pairs.n").alias("_n"),
        width.alias("bandwidth"),
        low.alias("_low"),
        high.alias("_high"),
    )
    values = _density_udf(points)("_s", "_n", "bandwidth", "_low", "_high")
    curves = ready.withColumn("_d", values).select(
        *keys, "bandwidth", "_low", "_high", F.posexplode("_d").alias("point", "density")
    )
    step = (F.col("_high") - F.col("_low")) / (points - 1)
    return curves.select(*keys, "point", (F.col("_low") + F.col("point") * step).alias("x"), "density", "bandwidth")


def peak(curves: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Where each curve is highest (the earliest such point)."""
    best = F.max_by("x", F.struct(F.col("density"), -F.col("x")))
    return curves.groupBy(*keys).agg(best.alias("x"), F.max("density").alias("density"))
