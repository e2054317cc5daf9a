"""One to three daily reading times per customer: optimal one-dimensional k-means.

Seconds are a line, so the best k clusters are k intervals of the sorted values and can be found
exactly (Wang & Song 2011, optimal k-means in one dimension by dynamic programming).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .stats import histogram

# Task code travels with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_DENSE = 512


def interval_cost(sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Weighted sum of squares of the sorted values i to j-1 around their mean."""
    n, s, q = sums[:, j] - sums[:, i]
    return np.maximum(q - s * s / np.maximum(n, 1.0), 0.0)


def _all_costs(sums: np.ndarray) -> np.ndarray:
    """Cost of every interval of a short row of values, infinite where it is empty."""
    ends = np.arange(sums.shape[1])
    start, stop = ends[:, None], ends[None, :]
    return np.where(start < stop, interval_cost(sums, start, stop), np.inf)


def best_last_cut(previous: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j: the cut i < j with the least previous[i] + cost(i, j).

    The best cut never moves left as j grows, so each round halves the open ends between ends
    that are settled, and one round costs about as many evaluations as there are values.
    """
    size = sums.shape[1]
    cost, cut = np.full(size, np.inf), np.zeros(size, dtype=np.int64)
    spans = np.array([[1, size - 1, 0, size - 2]])
    while len(spans):
        first, last, low, high = spans.T
        mid = (first + last) // 2
        widths = np.minimum(high, mid - 1) - low + 1
        starts = np.cumsum(widths) - widths
        i = np.arange(widths.sum()) - np.repeat(starts - low, widths)
        values = previous[i] + interval_cost(sums, i, np.repeat(mid, widths))
        least = np.minimum.reduceat(values, starts)
        hits = np.flatnonzero(values == np.repeat(least, widths))
        owner = np.searchsorted(starts, hits, side="right") - 1
        _, pick = np.unique(owner, return_index=True)
        cost[mid], cut[mid] = least, i[hits[pick]]
        left = np.stack([first, mid - 1, low, cut[mid]], axis=1)
        right = np.stack([mid + 1, last, cut[mid], high], axis=1)
        spans = np.concatenate([left, right])
        spans = spans[spans[:, 0] <= spans[:, 1]]
    return cost, cut


def optimal_intervals(values: np.ndarray, weights: np.ndarray, k_max: int) -> list[tuple[float, list[int]]]:
    """Least sum of squares and interval borders for each k up to ``k_max``.

    ``values`` are distinct and sorted.
    """
    centred = values - np.average(values, weights=weights)
    sums = np.zeros((3, len(values) + 1))
    sums[:, 1:] = np.cumsum([weights, weights * centred, weights * centred * centred], axis=1)
    end = len(values)
    ends = np.arange(end + 1)
    costs = [interval_cost(sums, np.zeros_like(ends), ends)]
    cuts: list[np.ndarray] = []
    table = _all_costs(sums) if end <= _DENSE else None
    for _ in range(1, min(k_max, end)):
        if table is None:
            cost, cut = best_last_cut(costs[-1], sums)
        else:
            options = costs[-1][:, None] + table
            cost, cut = options.min(axis=0), options.argmin(axis=0)
        costs.append(cost)
        cuts.append(cut)
    found = []
    for k, cost in enumerate(costs, start=1):
        borders = [end]
        for level in range(k - 2, -1, -1):
            borders.append(int(cuts[level][borders[-1]]))
        found.append((float(cost[end]), [0, *reversed(borders)]))
    return found


def centers_of(
    values: np.ndarray, weights: np.ndarray, k_max: int, cutoff: float | None, standardise: bool
) -> list[tuple[int, float, float, int]]:
    """Centres in time order, with their sums of squares and sizes.

    A further cluster is taken while it lowers the total sum of squares by more than ``cutoff``.
    """
    order = np.argsort(values)
    values, weights = values[order].astype(float), weights[order].astype(float)
    total = weights.sum()
    if cutoff is None:
        cutoff = min(0.02 + 10.0 / total + 2.5, 0.8)
    options = optimal_intervals(values, weights, k_max)
    wss, borders = options[0]
    spread = wss / (total - 1) if total > 1 else 0.0
    for candidate, cut in options[1:]:
        if wss <= 0 or 1 - candidate / wss <= cutoff:
            break
        wss, borders = candidate, cut
    unit = spread if standardise and spread > 0 else 1.0
    rows = []
    for number, (a, b) in enumerate(zip(borders, borders[1:]), start=1):
        w, v = weights[a:b], values[a:b]
        centre = float(np.average(v, weights=w))
        rows.append((number, centre, float((w * (v - centre) ** 2).sum() / unit), int(w.sum())))
    return rows


def customer_centers(
    events: DataFrame,
    keys: Sequence[str],
    secs: str = "secs",
    k_max: int = 3,
    min_distinct: int = 20,
    cutoff: float | None = None,
    standardise: bool = True,
    counted: str | None = None,
) -> DataFrame:
    """Centres per customer with at least ``min_distinct`` different seconds.

    Events are counted per customer and second first: a customer is one row with at most 86,400
    entries, so even one who owns a third of all events is a bounded task. ``counted`` names the
    weight of rows that are counts already, laid out by customer.
    """
    seconds = histogram(events, keys, secs, counted=counted)
    pair = F.when(F.col(secs).isNotNull(), F.struct(F.col(secs).alias("s"), F.col("n").alias("n")))
    # A missing second is one more value for the gate, but no point to cluster.
    customers = (
        (spread(seconds, *keys) if counted is None else seconds)
        .groupBy(*keys)
        .agg(F.collect_list(pair).alias("_pairs"), F.count("*").alias("_values"))
        .where((F.col("_values") >= min_distinct) & (F.size("_pairs") > 0))
        .select(*keys, F.col("_pairs.s").alias("_s"), F.col("_pairs.n").alias("_n"))
    )
    names = list(keys)

    def fit(batches):
        for pdf in batches:
            found = [
                (*row[:-2], *centre)
                for row in pdf[[*names, "_s", "_n"]].itertuples(index=False, name=None)
                for centre in centers_of(np.asarray(row[-2]), np.asarray(row[-1]), k_max, cutoff, standardise)
            ]
            yield pd.DataFrame(found, columns=[*names, "centroid", "secs", "wss", "size"])

    key_types = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    return customers.mapInPandas(fit, f"{key_types}, centroid int, secs double, wss double, size bigint")
