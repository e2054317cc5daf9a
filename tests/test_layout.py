"""Results do not depend on the number of partitions, and plans keep their shape."""

import pytest

from circadia.plans import habits
from circadia_checks import registry
from circadia_checks.compare import difference
from circadia_checks.oracles import ORACLES
from circadia_checks.registry import QUERIES
from circadia_checks.views import views
from conftest import SMALL

SAMPLE = [
    "weekday_hour_share",
    "customer_habit_profile",
    "typical_slot",
    "daily_customer_minutes",
    "category_weekday_hour_heatmap",
    "customer_peaks_fine",
    "win8_quantile_buckets",
    "rsh6_bucket_gap_rows",
    "profile_segments",
]


@pytest.mark.parametrize("partitions", ["1", "13"])
@pytest.mark.parametrize("name", SAMPLE)
def test_same_result_on_any_number_of_partitions(spark, name, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert difference(spark, QUERIES[name], ORACLES[name], SMALL) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins(spark):
    for name in ("customer_hour_heatmap", "rsh3_densify_inside", "top_members", "category_time_density", "agg7_median"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_read_needed_columns_only(spark):
    text = plan(QUERIES["agg3_whole_minutes"](spark, SMALL))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in text


def test_events_are_not_shuffled_to_meet_eight_weekday_rows(spark):
    events = registry.customer_events(views(spark, SMALL))
    text = plan(habits.weekday_start_time(events))
    assert "SortMergeJoin" not in text
