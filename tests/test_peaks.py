"""Optimal one-dimensional clustering against brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from circadia.operators import peaks
from circadia.plans import segments


def brute(values, weights, k):
    def cost(a, b):
        v, w = values[a:b], weights[a:b]
        m = np.average(v, weights=w)
        return float((w * (v - m) ** 2).sum())

    best = np.inf
    for cut in combinations(range(1, len(values)), k - 1):
        edges = [0, *cut, len(values)]
        best = min(best, sum(cost(a, b) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_least_cost_for_every_k(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 18))
    values = np.sort(rng.choice(86400, size, replace=False)).astype(float)
    weights = rng.integers(1, 6, size).astype(float)
    if seed % 2:
        monkeypatch.setattr(peaks, "_DENSE", 0)
    found = peaks.optimal_intervals(values, weights, 4)
    assert len(found) == min(4, size)
    for k, (cost, borders) in enumerate(found, start=1):
        assert borders[0] == 0 and borders[-1] == size and len(borders) == k + 1
        assert cost == pytest.approx(brute(values, weights, k), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("seed", range(8))
def test_long_and_short_routes_agree(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.choice(86400, 200 + 40 * seed, replace=False)).astype(float)
    weights = rng.integers(1, 4, len(values)).astype(float)
    short = peaks.optimal_intervals(values, weights, 4)
    monkeypatch.setattr(peaks, "_DENSE", 0)
    long = peaks.optimal_intervals(values, weights, 4)
    assert [c for c, _ in long] == pytest.approx([c for c, _ in short], rel=1e-9)
    assert [b for _, b in long] == [b for _, b in short]


def test_cost_never_rises_with_k():
    rng = np.random.default_rng(5)
    values = np.sort(rng.choice(86400, 500, replace=False)).astype(float)
    costs = [c for c, _ in peaks.optimal_intervals(values, np.ones(500), 6)]
    assert all(b <= a for a, b in zip(costs, costs[1:]))


def test_a_full_day_of_seconds_is_quick_and_right():
    values, weights = np.arange(86400.0), np.ones(86400)
    cost, borders = peaks.optimal_intervals(values, weights, 3)[2]
    assert borders == [0, 28800, 57600, 86400]
    assert cost == pytest.approx(3 * (28800.0**3 - 28800.0) / 12)


def test_centers_come_in_time_order_and_cover_all_events():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(20000, 21000, 40), rng.integers(70000, 71000, 40)])
    values = np.unique(values)
    rows = peaks.centers_of(values, np.ones(len(values)), 3, None, True)
    assert [r[0] for r in rows] == [1, 2] and rows[0][1] < rows[1][1]
    assert sum(r[3] for r in rows) == len(values)


def test_the_gate_counts_distinct_seconds_and_one_for_missing(spark):
    rows = [(1, i) for i in range(19)] + [(1, None)] + [(2, i % 19) for i in range(60)] + [(3, i) for i in range(20)]
    events = spark.createDataFrame(rows, "customer_key long, secs int")
    found = peaks.customer_centers(events, ["customer_key"])
    assert {r[0] for r in found.select("customer_key").distinct().collect()} == {1, 3}


def test_everyone_is_listed_and_tables_do_not_depend_on_partitions(spark):
    events = spark.range(3000).select(
        (F.col("id") % 40).alias("customer_key"),
        (F.pmod(F.xxhash64("id"), F.lit(86400))).cast("int").alias("secs"),
        F.lit("Monday").alias("week_day"),
    ).union(spark.createDataFrame([(777, 5, "Friday")], "customer_key long, secs int, week_day string"))
    tables = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        tables.append(sorted(map(str, segments.customer_peaks(events, cutoff=0.5).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert tables[0] == tables[1] and len(tables[0]) == 41
