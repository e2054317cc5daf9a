"""Counts stored by day and bucketed by customer: same results as the events, few files read, no shuffle."""

import pytest

from circadia.plans import events as ev, habits, rhythm, segments
from circadia.session import scratch_path

CLOCK = "time_of_day_key int, time_of_day string"
FACT = "date_key int, customer_key long, time_of_day_key int"


@pytest.fixture(scope="module")
def clock(spark):
    return spark.createDataFrame([(s, f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}") for s in range(0, 86400, 600)], CLOCK)


def facts(spark, days=range(20240101, 20240115), hot=400):
    rows = []
    for day in days:
        for i in range(60):
            rows.append((day, (i * 7 + day) % 11, ((i * i + day) % 144) * 600))
        # one customer with most rows, the unknown one, an unknown time, a customer without a key
        rows += [(day, 3, (day * 37 % 100 + j % 5) * 600) for j in range(hot)]
        rows += [(day, -1, 600), (day, 5, -1), (day, None, 1200)]
    rows.append((None, 4, 600))
    return spark.createDataFrame(rows, FACT)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def kept(spark, fact, clock, **more):
    where = rhythm.layout(scratch_path(spark, "counts"), 4)
    return where, rhythm.store(spark, fact, clock, where, **more)


ANALYSES = {
    "profile": habits.habit_profile,
    "slot": habits.typical_slot,
    "regularity": segments.regularity_features,
    "bands": segments.band_share_features,
    "hours": segments.hour_share_features,
}


@pytest.mark.parametrize("name", ANALYSES)
def test_as_from_events(spark, rows, clock, name):
    fact = facts(spark)
    _, table = kept(spark, fact, clock)
    events = ev.customer_events(fact, clock, "2024-01-14", 10)
    if name in ("bands", "hours"):
        events = ev.segment_input(events)
    counts = rhythm.window(spark, table, "2024-01-14", 10)
    run = ANALYSES[name]
    key = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df)]
    assert key(run(counts, counted="n")) == key(run(events))
    assert len(key(run(counts, counted="n"))) > 5


def test_days_added_one_by_one_equal_a_rebuild(spark, rows, clock):
    fact = facts(spark)
    _, whole = kept(spark, fact, clock)
    where, table = kept(spark, fact.where("date_key < 20240110"), clock)
    for day in range(20240110, 20240115):
        rhythm.store(spark, fact, clock, where, table, [day])
        rhythm.store(spark, fact, clock, where, table, [day])  # a repeated call counts nothing twice
    assert rows(spark.table(table)) == rows(spark.table(whole))


def test_a_corrected_day_replaces_its_counts_and_a_named_empty_day_goes(spark, rows, clock):
    fact = facts(spark, range(20240101, 20240104))
    where, table = kept(spark, fact, clock)
    late = spark.createDataFrame([(20240102, 8, 1200), (20240103, 8, 1200)], FACT)
    rhythm.store(spark, late, clock, where, table, [20240102, 20240101, 20240220])
    assert rows(spark.table(table).where("date_key = 20240102")) == [(8, 1200, 1, 20240102)]
    assert rows(spark.table(table).where("date_key in (20240101, 20240220)")) == []
    untouched = rhythm.daily_counts(fact.where("date_key = 20240103"), clock).select("customer_key", "secs", "n", "date_key")
    assert rows(spark.table(table).where("date_key = 20240103")) == rows(untouched)


def test_a_table_is_found_again_and_may_be_empty(spark, rows, clock):
    fact = facts(spark, range(20240101, 20240103))
    where, table = kept(spark, fact, clock)
    assert rows(spark.table(where.register(spark))) == rows(spark.table(table))
    _, empty = kept(spark, fact.where("false"), clock)
    assert habits.habit_profile(rhythm.window(spark, empty, "2024-01-14"), counted="n").collect() == []


def test_a_hot_customer_is_a_row_per_second(spark, clock):
    _, table = kept(spark, facts(spark, hot=5000), clock)
    assert spark.table(table).where("customer_key = 3").groupBy("date_key").count().agg({"count": "max"}).first()[0] < 30


@pytest.mark.parametrize("name", ["slot", "regularity", "bands"])
def test_days_are_pruned_and_customers_not_shuffled(spark, clock, name):
    _, table = kept(spark, facts(spark), clock)
    counts = rhythm.window(spark, table, "2024-01-14", 3)
    per_customer = segments.workday_shares(counts, segments.hour_of(segments.F.col("secs")), "hour", counted="n")
    text = plan({"slot": lambda: habits.typical_slot(counts, counted="n"), "bands": lambda: per_customer,
                 "regularity": lambda: habits.median_time(counts, counted="n")}[name]())
    assert "Exchange" not in text
    assert "PartitionFilters: [isnotnull(date_key" in text and "20240111" in text and "Bucketed: true" in text


def test_profile_needs_no_shuffle(spark, clock):
    _, table = kept(spark, facts(spark), clock)
    assert "Exchange" not in plan(habits.habit_profile(rhythm.window(spark, table, "2024-01-14", 3), counted="n"))
