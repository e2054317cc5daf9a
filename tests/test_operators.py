"""Numbering, medians, densities, repeats and samples on data with a very hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from circadia.operators import density, grid, ranking, sampling, stats
from circadia.plans import completion


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a third of those with one value."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int")
    value = F.when(F.col("id") % 9 == 0, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(100000))).cast("double")
    return spark.range(30000).select("id", key.alias("k"), value.alias("v")).cache()


def test_exact_median_equals_the_built_in_one(skewed):
    ours = {r["k"]: r["median"] for r in stats.exact_median(skewed, ["k"], "v").collect()}
    theirs = {r["k"]: r["m"] for r in skewed.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert ours == theirs


def test_exact_median_of_null_groups_and_values(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, None), (2, 4.0), (2, None), (3, float("nan")), (3, 1.0), (3, float("nan"))], "k int, v double")
    ours = {r["k"]: r["median"] for r in stats.exact_median(df, ["k"], "v").collect()}
    assert ours.pop(3) != 0 and ours == {None: 1.5, 1: None, 2: 4.0}


@pytest.mark.parametrize("value", ["cast(id / 7 as decimal(38, 18))", "(1L << 60) + id * 3", "cast(id as float) / 3", "cast(id % 5 as byte)"])
def test_exact_median_of_any_type(spark, value):
    df = spark.range(301).selectExpr("cast(id % 3 as int) as k", f"{value} as v")
    ours = {r["k"]: r["median"] for r in stats.exact_median(df, ["k"], "v").collect()}
    theirs = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").cast("double").alias("m")).collect()}
    assert ours == pytest.approx(theirs, rel=1e-15)


def test_median_shuffles_no_row_on_the_group_key_alone(skewed):
    plan = stats.exact_median(skewed, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Scan ExistingRDD" in plan  # starts from the ranged, counted rows


def test_modal_value_is_the_smallest_of_the_most_frequent(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, None), (3, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert rows(stats.modal(df, ["k"], "v")) == [(1, "a"), (2, None), (3, "y")]


def test_values_outside_a_pivot_list_raise(spark):
    df = spark.createDataFrame([(1, 1), (1, 8)], "k int, b int")
    with pytest.raises(Exception, match="outside its list"):
        grid.pivot_presence(df, ["k"], "b", range(1, 8)).collect()


def test_densities_want_whole_numbers(spark):
    with pytest.raises(TypeError):
        density.density(spark.createDataFrame([(1.5,)], "s double"), "s")


def test_row_numbers_are_a_permutation_in_order(skewed):
    got = ranking.number_rows(skewed, ["v", "id"]).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 30001))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)
    assert {r["row_count"] for r in got} == {30000}


def test_weighted_sd_is_exact_for_huge_counts(spark):
    hist = spark.createDataFrame([(86399, 10**11), (86398, 10**11)], "v int, n long")
    got = hist.agg(stats.weighted_sd(F.col("v"), F.col("n"))).first()[0]
    assert got == pytest.approx(0.5, rel=1e-9)


def test_density_integrates_to_one(spark):
    df = spark.range(4000).select((F.col("id") % 4).alias("g"), (40000 + F.pmod(F.xxhash64("id"), F.lit(9000))).cast("int").alias("s"))
    curves = density.density(df, "s", ["g"], shared=True).toPandas()
    for _, c in curves.groupby("g"):
        assert np.trapezoid(c.sort_values("x").density, c.sort_values("x").x) == pytest.approx(1, abs=2e-3)
    assert curves.groupby("point").x.nunique().max() == 1


def test_density_equals_the_plain_sum(spark):
    secs = [100, 200, 200, 900, 4000]
    df = spark.createDataFrame([(s,) for s in secs], "s int")
    c = density.density(df, "s").orderBy("point").toPandas()
    q75, q25 = np.percentile(secs, [75, 25])
    h = 0.9 * min(np.std(secs, ddof=1), (q75 - q25) / 1.34) * 5**-0.2
    x = np.linspace(100, 4000, 512)
    want = np.exp(-0.5 * ((x[:, None] - np.array(secs)) / h) ** 2).sum(1) / (5 * h * np.sqrt(2 * np.pi))
    assert np.allclose(c.x, x) and np.allclose(c.density, want) and c.bandwidth.iloc[0] == pytest.approx(h)


def test_density_of_flat_and_tiny_groups(spark):
    df = spark.createDataFrame([("flat", 50), ("flat", 50), ("flat", 50), ("one", 7), ("none", None)], "g string, s int")
    assert {r[0] for r in density.density(df, "s", ["g"]).select("g").distinct().collect()} == {"flat"}


def test_peak_is_the_highest_point(spark):
    df = spark.createDataFrame([(s,) for s in [100, 4000, 5000, 6000, 9000]], "s int")
    curves = density.density(df, "s")
    top = density.peak(curves).first()
    assert top["density"] == curves.agg(F.max("density")).first()[0] and abs(top["x"] - 5000) < 200


def test_repeats_recycle_single_cells(spark, rows):
    long = spark.createDataFrame([("a", 1, "x", "y", 3), ("a", 2, "p", "q", 1), ("a", 3, "m", "n", 2)], "i string, b int, f string, r string, n long")
    got = rows(grid.expand_repeats(long, ["i"], "b", [1, 2, 3, 4], "f", "r", "n", fill="-", block=2))
    assert got == [("a", 1, "x", "p", "m", "-"), ("a", 2, "y", "p", "n", "-"), ("a", 3, "y", "p", None, "-")]


def test_gap_flags_by_hand(spark, rows):
    reads = spark.createDataFrame(
        [("t", "i", 1, b, n) for b, n in [(1, 1), (2, 2), (4, 1)]], "title string, isbn13 string, customer_key long, bucket_no int, n long"
    )
    assert rows(completion.bucket_gaps(reads, [1, 2, 3, 4]), "`1`", "`2`", "`3`", "`4`") == [(None, "1", None, "gap")]
    wide = rows(completion.bucket_gap_rows(reads, [1, 2, 3, 4]), "occurrence", "`1`", "`2`", "`4`")
    assert wide == [(1, None, "1", "gap"), (2, None, "gap", "gap")]
    assert rows(completion.bucket_matrix(reads, [1, 2, 3, 4]), "`1`", "`2`", "`3`", "`4`") == [(1, 1, 0, 1)]
    with pytest.raises(Exception, match="outside its list"):
        completion.bucket_matrix(reads, [1, 2, 3]).collect()


def test_gap_order_is_by_title_across_isbn(spark, rows):
    reads = spark.createDataFrame(
        [("t", "i", 1, 1, 1), ("t", "j", 1, 1, 1), ("t", "j", 1, 2, 1), ("t", None, 2, 5, 1)],
        "title string, isbn13 string, customer_key long, bucket_no int, n long",
    )
    got = rows(completion.gap_flags(reads), "customer_key", "isbn13", "bucket_no", "gap")
    assert got == [(1, "i", 1, None), (1, "j", 1, "gap"), (1, "j", 2, "1"), (2, None, 5, None)]


def test_the_matrix_has_a_hundred_buckets_by_default(spark):
    reads = spark.createDataFrame([("t", "i", 1, 100, 1)], "title string, isbn13 string, customer_key long, bucket_no int, n long")
    row = completion.bucket_matrix(reads).first()
    assert len(row) == 103 and row["100"] == 1 and row["1"] == 0


def test_samples_do_not_depend_on_the_layout(spark, skewed):
    def draw(df):
        return sorted(r[0] for r in sampling.sample_keys(df, ["id"], 25).collect())

    assert draw(skewed) == draw(skewed.repartition(13)) and len(draw(skewed)) == 25
    assert sampling.sample_keys(skewed, ["k"], 10**6).count() == skewed.select("k").distinct().count()
    share = sampling.sample_fraction(skewed, ["id"], 0.3).count() / 30000
    assert abs(share - 0.3) < 0.02


def test_split_is_a_partition(skewed):
    a, b = sampling.split(skewed, ["id"])
    assert a.count() + b.count() == 30000 and a.join(b, "id").count() == 0


def test_pivot_many_names_columns(spark):
    long = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 20, 3)], "k int, c int, time int, wss int")
    got = grid.pivot_many(long, ["k"], "c", [1, 2, 3], ["time", "wss"]).first().asDict()
    assert got == {"k": 1, "time_1": 10, "wss_1": 5, "time_2": 20, "wss_2": 3, "time_3": None, "wss_3": None}
    single = grid.pivot_many(long, ["k"], "c", [1, 2], ["time"]).first().asDict()
    assert single == {"k": 1, "time_1": 10, "time_2": 20}


def test_bit_sets_hold_any_list(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "d"), (2, "a"), (3, None)], "k int, v string")
    assert rows(grid.pivot_presence(df, ["k"], "v", ["d", "a", "b"])) == [(1, 1, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0)]
    wide = spark.createDataFrame([(1, n) for n in (-70, -1, 0, 61, 62, 130)] + [(2, 5)], "k int, v int")
    names = [-70, -1, 0, 5, 61, 62, 130]
    assert rows(grid.pivot_presence(wide, ["k"], "v", names)) == [(1, 1, 1, 1, 0, 1, 1, 1), (2, 0, 0, 0, 1, 0, 0, 0)]


def test_gap_matrix_equals_the_flags_bucket_by_bucket(spark):
    rng = random.Random(6)
    reads = [
        (f"t{rng.randint(1, 3)}", rng.choice(["i1", "i2", "i3", None]), rng.randint(1, 6), rng.choice([rng.randint(1, 100), rng.randint(60, 66)]), rng.randint(1, 3))
        for _ in range(900)
    ]
    df = spark.createDataFrame(reads, "title string, isbn13 string, customer_key long, bucket_no int, n long").repartition(5)
    flags = {(r["title"], r["isbn13"], r["customer_key"], r["bucket_no"]): r["gap"] for r in completion.gap_flags(df).collect()}
    found = completion.bucket_gaps(df).collect()
    assert len(found) == len({k[:3] for k in flags})
    for r in found:
        for b in range(1, 101):
            assert r[str(b)] == flags.get((r["title"], r["isbn13"], r["customer_key"], b)), (r, b)


def test_repeats_are_laid_out_after_the_last_shuffle(spark, rows):
    cells = [("x", 1, 1), ("x", 3, 3), ("y", 2, 5), (None, 3, 1), ("z", None, 4)]
    df = spark.createDataFrame(cells, "id string, b int, n long").withColumns({"first": F.lit(1), "again": F.lit(2)})
    wide = grid.expand_repeats(df, ["id"], "b", range(1, 31), "first", "again", "n", fill=0, block=2)
    none = [0] * 27
    expected = [
        (None, 1, 0, 0, 1, *none),
        ("x", 1, 1, 0, 1, *none), ("x", 2, 1, 0, 2, *none), ("x", 3, 1, 0, 2, *none),
        *[("y", i, 0, 1 if i == 1 else 2, 0, *none) for i in range(1, 6)],
        ("z", 1, 0, 0, 0, *none),
    ]
    assert rows(wide) == expected
    # an id's cells are one column where rows are grouped, sorted or shuffled: 30 columns would fill a task's memory
    open_, widths = [wide._jdf.queryExecution().optimizedPlan()], []
    while open_:
        node = open_.pop()
        if node.nodeName() in ("Aggregate", "RepartitionByExpression"):
            widths.append(node.output().size())
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    assert widths and max(widths) <= 5


def test_reads_spread_over_all_tasks(spark):
    fact = spark.createDataFrame([(1, 2, 3, 20240101, 1)] * 3, "customer_key long, product_key long, read_bucket_key int, date_key int, premium_key int")
    buckets = spark.createDataFrame([(3, 3)], "read_bucket_key int, bucket_no int")
    products = spark.createDataFrame([(2, "t", "i", "E-bøger")], "product_key long, title string, isbn13 string, type string")
    reads = completion.bucket_reads(fact, buckets, products)
    wide = completion.bucket_rows(reads, range(1, 4))
    assert [r["3"] for r in wide.collect()] == [1, 1, 1]
    # a stated number of partitions: merged ones would hold more the more rows there are
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
