"""Sketches against exact values, merged and whole, on skewed groups."""

import random

import pytest
from pyspark.sql import functions as F

from circadia.operators import sketches, stats
from circadia.plans import activity, usage


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns nine tenths of the rows, most of them of one value; one has no known value, one a single row."""
    rng = random.Random(4)
    rows = [("big", i % 11, 7 if rng.random() < 0.6 else int(rng.expovariate(0.0002))) for i in range(60_000)]
    rows += [(f"g{i % 5}", i % 11, rng.randint(0, 86_399)) for i in range(6_000)]
    rows += [("none", i, None) for i in range(3)] + [("one", 0, 42), ("big", 3, None), (None, 1, 5)]
    return spark.createDataFrame(rows, "g string, day int, v int").repartition(7).cache()


def _close(estimate, exact):
    return abs(estimate - exact) <= sketches.distinct_error() * exact + 1e-9


def test_distinct_counts_within_the_stated_error(skewed):
    exact = {r["g"]: r for r in skewed.groupBy("g").agg(F.count_distinct("v").alias("n"), F.max(F.col("v").isNull()).alias("null")).collect()}
    daily = sketches.distinct_sketches(skewed, ["g", "day"], ["v"])
    merged = sketches.merged_distinct(daily, ["g"], ["v"])
    whole = sketches.distinct_sketches(skewed, ["g"], ["v"])
    for made in (merged, whole):
        for count_null in (True, False):
            found = {r["g"]: r["v"] for r in sketches.distinct_counts(made, ["g"], ["v"], count_null).collect()}
            assert found.keys() == exact.keys()
            for g, r in exact.items():
                more = int(r["null"]) if count_null else 0
                assert _close(found[g] - more, r["n"]), (g, found[g], r)


def test_merging_days_is_the_whole_period(skewed):
    merged = sketches.merged_distinct(sketches.distinct_sketches(skewed, ["day"], ["g", "v"]), [], ["g", "v"])
    whole = sketches.distinct_sketches(skewed.repartition(2), [], ["g", "v"])
    assert sketches.distinct_counts(merged, [], ["g", "v"]).collect() == sketches.distinct_counts(whole, [], ["g", "v"]).collect()


def _rank_errors(df, found):
    joined = df.where("v is not null").join(found, df["g"].eqNullSafe(found["h"]))
    ranks = joined.groupBy("h").agg(F.avg((F.col("v") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("median")).cast("int")).alias("upto"))
    return {r["h"]: max(r["below"] - 0.5, 0.5 - r["upto"], 0) for r in ranks.collect()}


def test_medians_within_the_stated_rank(skewed):
    daily = sketches.quantile_sketches(skewed, ["g", "day"], "v")
    merged = sketches.merged_quantiles(daily, ["g"], "v").select(F.col("g").alias("h"), sketches.quantile("v").alias("median"))
    whole = sketches.medians(skewed, ["g"], "v").withColumnRenamed("g", "h")
    for found in (merged, whole):
        errors = _rank_errors(skewed, found)
        assert set(errors) == {"big", "g0", "g1", "g2", "g3", "g4", "one", None}
        assert max(errors.values()) <= sketches.RANK_ERROR
        assert found.where("h = 'none'").first()["median"] is None


def test_outliers_by_sketches(skewed):
    """Rows far from the edge of the rule are judged alike."""
    known = skewed.where("g like 'g%' and v is not null")
    exact = stats.drop_outliers(known, ["g"], "v", "within", 1.0)
    near = stats.drop_outliers(known, ["g"], "v", "within", 1.0, approximate=True)
    assert abs(exact.count() - near.count()) <= 4 * sketches.RANK_ERROR * known.count()
    spreads = stats.median_and_sd(stats.histogram(skewed, ["g"], "v"), ["g"], "v").select("g", "sd")
    assert sorted(spreads.collect(), key=str) == sorted(sketches.median_and_sd(skewed, ["g"], "v").select("g", "sd").collect(), key=str)


def test_unknown_values_under_propagate(skewed):
    with pytest.raises(ValueError):
        stats.drop_outliers(skewed, ["g"], "v", "within", unknown="propagate", approximate=True)


def test_column_cardinalities(spark, skewed):
    exact, near = activity.column_cardinalities(skewed).first(), activity.column_cardinalities(skewed, approximate=True).first()
    assert all(_close(near[c], exact[c]) for c in skewed.columns)
    nothing = activity.column_cardinalities(skewed.where("false"), approximate=True).first()
    assert tuple(nothing) == (0, 0, 0)


def test_daily_minutes(spark):
    rng = random.Random(2)
    rows = [(d, c, p, float(rng.randint(1, 90) * 60_000)) for d in ("2024-01-01", "2024-01-02") for c in range(900) for p in range(2)]
    clean = spark.createDataFrame(rows, "date string, customer_key long, product_key long, msec double").withColumn("date", F.to_date("date"))
    exact = {r["date"]: r for r in usage.daily_customer_minutes(clean).collect()}
    near = {r["date"]: r for r in usage.daily_customer_minutes(clean, approximate=True).collect()}
    for day, r in exact.items():
        assert near[day]["mean"] == r["mean"] and abs(near[day]["median"] - r["median"]) <= 4
