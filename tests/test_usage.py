"""Two periods from one pass over each fact."""

import pytest
from pyspark.sql import functions as F

from circadia.plans import usage


@pytest.fixture(scope="module")
def facts(spark):
    members = [(1, "a", "Yes"), (2, "b", "Yes"), (3, "b", "Yes"), (4, None, "Yes"), (5, "e", "No"), (6, "f", "Yes"), (7, "g", "Yes")]
    reads = [(c, d) for c in range(1, 7) for d in (20240101, 20240110, 20240120)] + [(6, 20231231), (7, 20240120)]
    durations = [(c, d, 90_000 * c) for c in range(1, 6) for d in (20240102, 20240116)] + [(6, 20240103, 60_000), (7, 20231230, 1), (2, 20240117, None)]
    return (
        spark.createDataFrame(members, "customer_key long, email string, streaming_benefit string"),
        spark.createDataFrame(reads, "customer_key long, date_key int"),
        spark.createDataFrame(durations, "customer_key long, read_duration_date_key int, milliseconds_spent long"),
    )


def test_both_facts_rule_in_each_period(facts):
    recent = sorted(map(tuple, usage.member_usage(*facts, 20240115).collect()), key=str)
    assert recent == sorted([("a", 1, 1), ("b", 1, 3), ("b", 1, 4), (None, 1, 6)], key=str)
    whole = {(r[0], r[1], r[2]) for r in usage.member_usage(*facts, 20240101, "_ytd").collect()}
    assert whole == {("a", 3, 2), ("b", 3, 6), ("b", 3, 8), (None, 3, 12), ("f", 3, 1)}


def test_periods_meet_by_address_like_separate_tables(facts):
    recent, whole = usage.member_usage(*facts, 20240115, "_recent"), usage.member_usage(*facts, 20240101, "_ytd")
    joined = recent.join(whole.withColumnRenamed("email", "_e"), F.col("email").eqNullSafe(F.col("_e"))).drop("_e")
    found = usage.top_members(*facts, 20240115, 20240101, n=100)
    key = lambda r: tuple(str(r[c]) for c in sorted(r.asDict()))
    assert sorted(map(key, found.collect())) == sorted(map(key, joined.collect()))


def test_facts_are_read_once(spark, facts, tmp_path):
    """The pass over the facts is stored; what follows reads neither of them."""
    stored = []
    for i, table in enumerate(facts):
        table.write.parquet(str(tmp_path / str(i)))
        stored.append(spark.read.parquet(str(tmp_path / str(i))))
    one_pass = usage._usage_since(*stored, {"_recent": 20240115, "_ytd": 20240101})
    text = one_pass._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 3
    assert "FileScan" not in usage.top_members(*stored, 20240115, 20240101)._jdf.queryExecution().executedPlan().toString()
