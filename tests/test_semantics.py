"""One small frame per null, tie and ratio rule."""

import datetime as dt

from pyspark.sql import functions as F

from circadia.functions import calendar as cal, clock, semantics as sem, text
from circadia.operators import grid, joins, ranking, scaling, stats


def one(df, column):
    return df.select(column.alias("x")).first()[0]


def values(df, column):
    return [r[0] for r in df.select(column.alias("x")).collect()]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert values(df, sem.not_in(F.col("x"), ["a"])) == [False, True, True]


def test_if_else_of_unknown_is_unknown(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "x int")
    assert values(df, sem.if_else(F.col("x") > 5, F.lit("y"), F.lit("n"))) == ["n", "y", None]


def test_case_falls_through_on_unknown(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert one(df, F.when(F.col("x") > 1, "a").otherwise("b")) == "b"


def test_distinct_count_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,)], "x int")
    got = df.agg(sem.count_distinct(F.col("x")).alias("a"), sem.count_distinct(F.col("x"), False).alias("b")).first()
    assert tuple(got) == (3, 2)
    assert df.limit(0).agg(sem.count_distinct(F.col("x"))).first()[0] == 0


def test_null_safe_join_matches_null(spark, rows):
    a = spark.createDataFrame([(1, "a"), (None, "n")], "k int, l string")
    b = spark.createDataFrame([(None, "N"), (2, "B")], "k int, r string")
    assert rows(joins.null_safe_join(a, b, ["k"])) == [(None, "n", "N")]
    full = rows(joins.null_safe_join(a, b, ["k"], "full"))
    assert full == [(None, "n", "N"), (1, "a", None), (2, None, "B")]


def test_duplicate_emails_multiply_in_a_natural_join(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "email string, l int")
    b = spark.createDataFrame([("x", 3), ("x", 4)], "email string, r int")
    assert joins.null_safe_join(a, b, ["email"]).count() == 4


def test_top_keeps_ties(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 4), (2, "d", 1)], "k int, v string, n int")
    assert rows(ranking.top_with_ties(df, ["k"], "n"), "k", "v") == [(1, "a"), (1, "b"), (2, "d")]


def test_global_top_keeps_ties_and_leaves_null_out(spark, rows):
    df = spark.createDataFrame([(9,), (7,), (7,), (7,), (1,), (None,)], "n int")
    assert rows(ranking.top_n_with_ties(df, "n", 2)) == [(7,), (7,), (7,), (9,)]
    assert ranking.top_n_with_ties(df, "n", 100).count() == 5


def test_mode_prefers_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "x string")
    assert df.agg(sem.mode(F.col("x"))).first()[0] == "a"


def test_minutes_truncate_per_row(spark):
    df = spark.createDataFrame([(119999,), (119999,)], "ms long")
    got = df.agg(F.sum(clock.whole_minutes(F.col("ms"))).alias("w"), clock.minutes(F.sum("ms")).alias("f")).first()
    assert got["w"] == 2 and abs(got["f"] - 3.99996667) < 1e-6


def test_median_averages_and_sd_of_one_is_null(spark):
    hist = spark.createDataFrame([(1, 10, 1), (1, 20, 1), (2, 5, 1)], "k int, v int, n long")
    got = {r["k"]: (r["median"], r["sd"]) for r in stats.median_and_sd(hist, ["k"], "v").collect()}
    assert got[1][0] == 15.0 and abs(got[1][1] - 50**0.5) < 1e-12
    assert got[2] == (5.0, None)


def test_missing_values_skip_or_propagate(spark):
    hist = spark.createDataFrame([(1, 10, 2), (1, None, 1)], "k int, v int, n long")
    assert stats.median_and_sd(hist, ["k"], "v").first()["median"] == 10.0
    strict = stats.median_and_sd(hist, ["k"], "v", unknown="propagate").first()
    assert strict["median"] is None and strict["sd"] is None


def test_outlier_rules_differ_on_flat_and_single_groups(spark, rows):
    df = spark.createDataFrame([("flat", 7), ("flat", 7), ("one", 3)], "k string, v int")
    assert rows(stats.drop_outliers(df, ["k"], "v", "not_beyond")) == [("flat", 7), ("flat", 7)]
    assert rows(stats.drop_outliers(df, ["k"], "v", "within")) == []


def test_outlier_limits_use_the_whole_group(spark, rows):
    df = spark.createDataFrame([("a", v) for v in [10, 11, 12, 13, 14, 15, 16, 17, 18, 500]], "k string, v int")
    kept = rows(stats.drop_outliers(df, ["k"], "v", "within"))
    assert ("a", 500) not in kept and len(kept) == 9


def test_outlier_groups_include_the_null_key(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "k string, v int")
    assert len(rows(stats.drop_outliers(df, ["k"], "v", "within"))) == 3


def test_grid_keeps_rows_outside_it(spark, rows):
    df = spark.createDataFrame([(1, 0, 4), (1, None, 2)], "k int, h int, n long")
    assert rows(grid.densify(df, ["k"], {"h": range(2)}, "n")) == [(1, None, 2), (1, 0, 4), (1, 1, 0)]
    assert rows(grid.densify(df, ["k"], {"h": range(2)}, "n", keep_outside=False)) == [(1, 0, 4), (1, 1, 0)]


def test_grid_of_an_emptied_key(spark, rows):
    df = spark.createDataFrame([(1, 0, 4)], "k int, h int, n long")
    everyone = spark.createDataFrame([(1,), (2,)], "k int")
    full = rows(grid.densify(df, ["k"], {"h": range(2)}, "n", domain=everyone))
    assert full == [(1, 0, 4), (1, 1, 0), (2, 0, 0), (2, 1, 0)]


def test_grid_without_rows(spark, rows):
    df = spark.createDataFrame([], "h int, n long")
    assert rows(grid.densify(df, [], {"h": range(3)}, "n")) == [(0, 0), (1, 0), (2, 0)]


def test_scaling_skips_nulls_and_flattens_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = [tuple(r) for r in scaling.standardise(df, ["a", "b"]).select("a_scaled", "b_scaled").collect()]
    assert got[2] == (None, 0.0)
    assert abs(got[0][0] + 0.5**0.5) < 1e-12 and abs(got[1][0] - 0.5**0.5) < 1e-12


def test_remove_first_removes_once(spark):
    df = spark.createDataFrame([("Bøger|Bøger|x",), ("none",)], "x string")
    assert values(df, text.remove_first(F.col("x"), r"Bøger\|")) == ["Bøger|x", "none"]


def test_step_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (4.9,)], "x double")
    assert values(df, clock.round_to_step(F.col("x"), 2)) == [0, 4, 4, 4]


def test_quantile_buckets_leave_null_out_and_front_load(spark, rows):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)] + [(99, None)], "k int, v double")
    got = {r["k"]: r["bucket"] for r in ranking.quantile_bucket(df, "v", 5, ["k"]).collect()}
    assert [got[i] for i in range(7)] == [1, 1, 2, 2, 3, 4, 5] and got[99] is None


def test_fewer_rows_than_buckets(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert sorted(r["bucket"] for r in ranking.quantile_bucket(df, "v", 5, ["k"]).collect()) == [1, 2]


def test_weekday_is_monday_first(spark):
    df = spark.createDataFrame([(20240101,), (20240107,)], "k int")
    day = cal.iso_weekday(cal.date_of_key(F.col("k")))
    assert values(df, day) == [1, 7]
    assert values(df, cal.weekday_label(day, "danish")) == ["Mandag", "Søndag"]
    assert values(df, cal.weekday_ordinal(cal.weekday_label(day))) == [1, 7]
    assert values(df, cal.weekend_flag(day)) == ["no", "yes"]


def test_bad_calendar_keys_give_null(spark):
    keys = [20240229, 20230229, 20241301, 20240100, 2024011, 202401011, 0, -1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    assert values(df, cal.date_of_key(F.col("k"))) == [dt.date(2024, 2, 29)] + [None] * 8


def test_day_class_of_an_unknown_label(spark):
    df = spark.createDataFrame([("Sunday",), ("Friday",), (None,)], "x string")
    assert values(df, cal.day_class(F.col("x"))) == ["Weekend", "Workday", None]


def test_zero_total_gives_a_null_share(spark):
    df = spark.createDataFrame([(1, 0), (2, 3)], "k int, n int")
    got = {r["k"]: r["s"] for r in ranking.share_of_group(df, ["k"], "n", "s").collect()}
    assert got == {1: None, 2: 1.0}


def test_first_row_per_key_takes_the_smallest_and_null_last(spark, rows):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 2, "a"), (2, None, "z")], "k int, x int, y string")
    assert rows(ranking.first_row_per_key(df, ["k"])) == [(1, 2, "a"), (2, None, "z")]


def test_joined_label_prints_na(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert one(df, text.joined_label(F.col("x"), F.col("y"))) == "a - NA"


def test_clock_text_and_back(spark):
    df = spark.createDataFrame([("00:00:00",), ("7:05",), ("23:59:59",), ("24:00:00",), ("x",), (None,)], "t string")
    secs = clock.seconds_of_text(F.col("t"))
    assert values(df, secs) == [0, 25500, 86399, None, None, None]
    assert values(df, clock.clock_text(secs)) == ["00:00:00", "07:05:00", "23:59:59", None, None, None]


def test_bands_wrap_midnight(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    got = values(df, clock.time_band(F.col("h")))
    assert got[22:] + got[:3] == ["Night"] * 5 and got[3] == got[6] == "EarlyMorning" and got[21] == "Evening"
    assert set(got) == set(clock.BAND_NAMES)


def test_interval_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 4, 5, 8, None]], "x int")
    got = {r["x"]: r["bin"] for r in scaling.interval_bin(df, "x", 2).collect()}
    assert got == {0: 0, 1: 0, 4: 0, 5: 1, 8: 1, None: None}
    flat = spark.createDataFrame([(3,), (3,)], "x int")
    assert {r["bin"] for r in scaling.interval_bin(flat, "x", 4).collect()} == {0}


def test_sorting_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "x int")
    assert [r[0] for r in ranking.sorted_rows(df, "x").collect()] == [1, 2, None]
    assert [r[0] for r in ranking.sorted_rows(df, "-x").collect()] == [2, 1, None]
