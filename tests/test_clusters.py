"""Invariants of the clusterings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from circadia.operators import kmeans, kmodes

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i, float(x), float(y))
        for i, (x, y) in enumerate(np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (5, 5), (9, 0))]))
    ]
    return spark.createDataFrame(rows, "id int, a double, b double").cache()


def test_rows_go_to_the_nearest_centre(blobs):
    found = kmeans.fit(blobs, COLUMNS, 3)
    assert found.k == 3 and found.centers == sorted(found.centers)
    centers = np.array(found.centers)
    for r in found.assign(blobs).collect():
        d = ((centers - [r["a"], r["b"]]) ** 2).sum(1)
        assert r["cluster"] == d.argmin() + 1
    direct = {r["id"]: r["cluster"] for r in kmeans.nearest(blobs, COLUMNS, found.centers).collect()}
    assert direct == {r["id"]: r["cluster"] for r in found.assign(blobs).collect()}


def test_spread_per_cluster_adds_up(blobs):
    found = kmeans.fit(blobs, COLUMNS, 3, max_iter=50)
    total = kmeans.cluster_spread(found.assign(blobs), COLUMNS).agg(F.sum("wss")).first()[0]
    assert total == pytest.approx(found.wss, rel=1e-6)


def test_elbow_starts_with_the_total_and_falls(blobs):
    curve = {r["centroids"]: r["wss"] for r in kmeans.elbow(blobs, COLUMNS, [1, 2, 3, 4]).collect()}
    total = blobs.agg((F.var_pop("a") + F.var_pop("b")) * F.count("*")).first()[0]
    assert curve[1] == pytest.approx(total)
    assert curve[1] > curve[2] > curve[3] and curve[4] <= curve[3] * 1.1


def test_estimated_number_of_clusters(blobs):
    assert kmeans.estimate_k(blobs, COLUMNS, 8, cutoff=0.4).k == 3
    assert kmeans.estimate_k(blobs, COLUMNS, 1).k == 1


def test_published_cutoff():
    assert kmeans.gain_cutoff(1000, 24) == pytest.approx(0.02 + 0.01 + 2.5 / 576)
    assert kmeans.gain_cutoff(1000, 1) == 0.8


def test_no_more_centres_than_points(spark):
    df = spark.createDataFrame([(float(i % 3), 0.0) for i in range(30)], "a double, b double")
    found = kmeans.fit(df, COLUMNS, 9)
    assert found.k <= 9 and len({tuple(c) for c in found.centers}) <= 3
    assert found.assign(df).where(F.col("cluster").isNull()).count() == 0


def test_replicates_are_listed(blobs):
    table = kmeans.stability(blobs, ["id"], COLUMNS, replicates=3, k_max=3)
    assert {r[0] for r in table.select("replicate").distinct().collect()} == {1, 2, 3}
    assert blobs.is_cached


def test_one_cluster_of_single_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert kmeans.fit(df, COLUMNS, 1).wss == 0.0
    assert kmeans.estimate_k(df, COLUMNS, 3).k == 1


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [("x", "p", None)] * 30 + [("x", "q", None)] * 4 + [("y", "q", "m")] * 20 + [("y", "p", "m")] * 3 + [("z", "p", "n")] * 2
    return spark.createDataFrame(rows, "u string, v string, w string")


def test_modes_are_stable_and_rows_go_to_the_nearest(profiles):
    found = kmodes.fit(profiles, ["u", "v", "w"], 2)
    assert found.modes == [("x", "p", None), ("y", "q", "m")]
    for r in found.assign(profiles).collect():
        d = [sum(a != b for a, b in zip((r["u"], r["v"], r["w"]), m)) for m in found.modes]
        assert r["cluster"] == d.index(min(d)) + 1
    assert found.named(found.assign(profiles)).where("u = 'x' and v = 'p'").first()["segment"] == "x - p - NA"


def test_modes_elbow_falls_to_zero(profiles):
    curve = {r["modes"]: r["mean_within"] for r in kmodes.elbow(profiles, ["u", "v", "w"], range(1, 8)).collect()}
    assert curve[1] == 30 * 0 + 4 * 1 + 20 * 3 + 3 * 2 + 2 * 2
    assert curve[5] == 0 and curve[7] == 0


def test_several_fits_equal_single_fits(profiles):
    together = kmodes.fit_all(profiles, ["u", "v", "w"], [1, 2, 3])
    for k, state in together.items():
        alone = kmodes.fit(profiles, ["u", "v", "w"], k)
        assert alone.modes == state.modes and alone.within == state.within


def _lloyd(points, centers):
    """Plain rounds on rows in memory, by the module's rules."""
    points = np.round(points * kmeans.UNIT) / kmeans.UNIT
    while True:
        d = ((points[:, None, :] - centers[None]) ** 2).sum(2)
        own = d.argmin(1)
        moved = np.array([points[own == c].mean(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        if np.abs(moved - centers).max() <= kmeans.TOLERANCE:
            return centers, d.min(1).sum()
        centers = moved


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, s, (90, 2)) for c, s in (((0, 0), 0.3), ((4, 1), 0.6), ((9, -3), 0.2), ((2, 7), 0.9))])
    points = np.concatenate([points, points[:40]])
    rows = [(i, float(x), float(y), "n") for i, (x, y) in enumerate(points)] + [(900, None, 1.0, "n"), (901, 0.0, None, "n")]
    return points, spark.createDataFrame(rows, "id int, a double, b double, n string")


def _start(df, k):
    with kmeans._collapsed(df, COLUMNS) as rows:
        return kmeans._far_apart(rows.samples(1, 62)[0], k)


@pytest.mark.parametrize("task_rows", [20_000, 30])
def test_fits_equal_plain_rounds_in_any_layout(monkeypatch, cloud, task_rows):
    monkeypatch.setattr(kmeans, "TASK_ROWS", task_rows)
    points, df = cloud
    known = None
    for parts in (1, 8, 13):
        found = kmeans.fit_each(df.repartition(parts), COLUMNS, [1, 2, 5, 9])
        known = known or found
        assert [(f.centers, f.wss) for f in found] == [(f.centers, f.wss) for f in known]
    for f in known:
        centers, wss = _lloyd(points, _start(df, f.k))
        assert f.centers == pytest.approx(np.array(sorted(centers.tolist())), abs=1e-8)
        assert f.wss == pytest.approx(wss, rel=1e-9)


@pytest.mark.parametrize("task_rows", [20_000, 30])
def test_estimated_number_does_not_depend_on_the_layout(monkeypatch, cloud, task_rows):
    monkeypatch.setattr(kmeans, "TASK_ROWS", task_rows)
    found = [kmeans.estimate_k(cloud[1].repartition(parts), COLUMNS, 8, cutoff=0.3) for parts in (1, 8, 13)]
    assert {f.k for f in found} == {4}
    assert all(f.centers == found[0].centers and f.wss == found[0].wss for f in found)


def test_one_task_and_many_tasks_agree(monkeypatch, cloud):
    ways = []
    for task_rows in (20_000, 30):
        monkeypatch.setattr(kmeans, "TASK_ROWS", task_rows)
        ways.append([(f.centers, f.wss) for f in kmeans.fit_each(cloud[1], COLUMNS, range(1, 7))])
    assert ways[0] == ways[1]


def test_replicates_equal_separate_fits(cloud):
    df = cloud[1]
    table = kmeans.stability(df, ["id"], COLUMNS, replicates=4, k_max=5)
    for r in range(1, 5):
        alone = kmeans.estimate_k(df.where(kmeans.in_split(["id"], 0.75, 62 + r)), COLUMNS, 5)
        got = [[x["a"], x["b"]] for x in table.where(F.col("replicate") == r).orderBy("centroid").collect()]
        assert got == alone.centers


def test_replicates_beyond_one_number_of_bits(monkeypatch, cloud):
    whole = kmeans.stability(cloud[1], ["id"], COLUMNS, replicates=5, k_max=2).collect()
    monkeypatch.setattr(kmeans, "MOST_REPLICATES", 2)
    assert kmeans.stability(cloud[1], ["id"], COLUMNS, replicates=5, k_max=2).collect() == whole


def test_unknown_features_have_no_cluster(cloud):
    found = kmeans.fit(cloud[1], COLUMNS, 3)
    assert {r["id"] for r in found.assign(cloud[1]).where("cluster is null").collect()} == {900, 901}


def test_rounds_have_a_limit(monkeypatch, cloud):
    for task_rows in (20_000, 30):
        monkeypatch.setattr(kmeans, "TASK_ROWS", task_rows)
        with pytest.raises(RuntimeError):
            kmeans.fit(cloud[1], COLUMNS, 9, max_iter=1)


def test_fits_take_the_rounds_they_need(monkeypatch, spark):
    # values without gaps settle slowly: 24 centres take more than 400 rounds
    points = -np.log(np.arange(1, 6001) / 6001)[:, None] * 20
    df = spark.createDataFrame([(float(x),) for (x,) in points], "a double")
    with kmeans._collapsed(df, ["a"]) as rows:
        starts = kmeans._far_apart(rows.samples(1, 62)[0], 24)
    ways = []
    # few rows followed between passes, and all rows in one task
    for task_rows, near in ((1500, 3000), (20_000, 1_000_000)):
        monkeypatch.setattr(kmeans, "TASK_ROWS", task_rows)
        monkeypatch.setattr(kmeans, "NEAR_VALUES", near)
        ways.append([(f.centers, f.wss) for f in kmeans.fit_each(df, ["a"], [3, 24])])
    assert ways[0] == ways[1]
    centers, wss = _lloyd(points, starts)
    assert ways[0][1][0] == pytest.approx(np.array(sorted(centers.tolist())), abs=1e-8)
    assert ways[0][1][1] == pytest.approx(wss, rel=1e-9)
    with pytest.raises(RuntimeError):
        kmeans.fit(df, ["a"], 24, max_iter=300)


def test_collapsed_rows_spread_over_their_tasks(monkeypatch, cloud):
    monkeypatch.setattr(kmeans, "TASK_ROWS", 30)
    with kmeans._collapsed(cloud[1].coalesce(1), COLUMNS) as rows:
        assert rows.table.rdd.getNumPartitions() == rows.tasks == 12


def test_followed_rows_keep_plain_rounds():
    # the rows of small margin and the totals of all give the centres of all
    rng = np.random.default_rng(5)
    values = np.rint(rng.uniform(0, 9, (4000, 2)) * kmeans.UNIT).astype(np.int64)
    weight = rng.integers(1, 4, 4000)
    centers = values[:7] / kmeans.UNIT
    own, _, margin = kmeans._nearest(values, centers)
    totals = kmeans._totals(values, weight, own, 7)
    for reach in (0.5, 1.5, 4.0):
        near = margin < reach
        found, rounds, _ = kmeans._followed(values[near], weight[near], centers, None, totals, reach)
        plain = centers
        for _ in range(rounds):
            plain = kmeans._moved(plain, *kmeans._totals(values, weight, kmeans._nearest(values, plain)[0], 7))
        assert rounds and found.tolist() == plain.tolist()


def test_no_rows(spark):
    with pytest.raises(ValueError):
        kmeans.fit(spark.createDataFrame([(None, 1.0)], "a double, b double"), COLUMNS, 2)
