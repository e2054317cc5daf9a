"""k-modes: clusters of categorical rows under simple matching distance.

Rows collapse to distinct profiles with counts. Assignment is one projection over literal modes;
an update is one aggregate that returns k x columns values. The modes are the only thing the
driver holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def _values(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def _mode_rows(modes: Sequence[tuple]) -> Column:
    return F.array(*[F.array(*[F.lit(v).cast("string") for v in m]) for m in modes])


def _nearest(values: Column, modes: Column) -> Column:
    """(distance, number) of the nearest mode, the first one on a tie."""
    def measured(mode: Column, at: Column) -> Column:
        misses = F.zip_with(values, mode, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1))
        distance = F.aggregate(misses, F.lit(0), lambda total, miss: total + miss)
        return F.struct(distance.alias("d"), (at + 1).alias("cluster"))

    return F.array_min(F.transform(modes, measured))


@dataclass
class Modes:
    """Fitted modes, one tuple of category values (as text) per cluster."""

    columns: list[str]
    modes: list[tuple]
    within: list[int]

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """Number of the nearest mode; the first one on a tie."""
        return df.withColumn(name, _nearest(_values(self.columns), _mode_rows(self.modes))["cluster"])

    def named(self, df: DataFrame, cluster: str = "cluster", name: str = "segment") -> DataFrame:
        """Name each cluster by its mode's values."""
        labels = [" - ".join("NA" if v is None else str(v) for v in m) for m in self.modes]
        return df.withColumn(name, F.get(F.array(*[F.lit(x) for x in labels]), F.col(cluster) - 1))


#: Rounds after which modes that still change raise.
MAX_ITER = 300


def profiles(df: DataFrame, columns: Sequence[str], weight: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(weight))


def _starts(table: DataFrame, columns: Sequence[str], k: int) -> list[tuple]:
    """The k most frequent profiles, ties in column order."""
    rows = table.orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in columns]).limit(k)
    return [tuple(r[0]) for r in rows.select(_values(columns)).collect()]


def _tagged(table: DataFrame, states: dict[int, Modes]) -> DataFrame:
    """Each profile once per solution, with its cluster and distance there."""
    columns = next(iter(states.values())).columns
    solutions = F.array(*[
        F.struct(F.lit(k).alias("k"), _mode_rows(s.modes).alias("modes")) for k, s in states.items()
    ])
    rows = table.select("n", _values(columns).alias("_values")).select("*", F.explode(solutions).alias("_s"))
    near = rows.select("n", "_values", F.col("_s.k").alias("_k"), _nearest(F.col("_values"), F.col("_s.modes")).alias("_near"))
    return near.select("n", "_values", "_k", F.col("_near.cluster").alias("_cluster"), F.col("_near.d").alias("_d"))


def _updates(table: DataFrame, states: dict[int, Modes]) -> dict[int, list[tuple]]:
    """Most frequent value per cluster and column (the smallest on a tie), for each solution."""
    long = _tagged(table, states).select("_k", "_cluster", "n", F.posexplode("_values").alias("_at", "_value"))
    cell = ["_k", "_cluster", "_at"]
    votes = long.groupBy(*cell, "_value").agg(F.sum("n").alias("_votes"))
    winner = F.min_by("_value", F.struct(-F.col("_votes"), F.col("_value").isNull(), F.col("_value")))
    found = {tuple(r)[:3]: r[3] for r in votes.groupBy(*cell).agg(winner).collect()}
    return {
        k: [tuple(found.get((k, i, j), old) for j, old in enumerate(m)) for i, m in enumerate(s.modes, start=1)]
        for k, s in states.items()
    }


def fit_all(df: DataFrame, columns: Sequence[str], ks: Sequence[int], max_iter: int = MAX_ITER) -> dict[int, Modes]:
    """Modes for several k at once, each starting from the k most frequent profiles.

    All solutions share every pass over the profiles. A solution has fewer modes than asked for
    if there are fewer profiles.
    """
    table = profiles(df, columns).persist()
    try:
        first = _starts(table, columns, max(ks))
        done: dict[int, Modes] = {}
        open_: dict[int, Modes] = {k: Modes(list(columns), first[:k], []) for k in ks if first}
        for _ in range(max_iter):
            if not open_:
                break
            for k, modes in _updates(table, open_).items():
                if modes == open_[k].modes:
                    done[k] = open_.pop(k)
                else:
                    open_[k].modes = modes
        if open_:
            raise RuntimeError(f"modes for k = {sorted(open_)} still change after {max_iter} rounds")
        if done:
            spread = _tagged(table, done).groupBy("_k", "_cluster").agg(F.sum(F.col("_d") * F.col("n")))
            sums = {(r[0], r[1]): int(r[2]) for r in spread.collect()}
            for k, state in done.items():
                state.within = [sums.get((k, i), 0) for i in range(1, len(state.modes) + 1)]
    finally:
        table.unpersist()
    return {k: done[k] for k in ks if k in done}


def fit(df: DataFrame, columns: Sequence[str], k: int, max_iter: int = MAX_ITER) -> Modes:
    found = fit_all(df, columns, [k], max_iter)
    if not found:
        raise ValueError("no rows to cluster")
    return found[k]


def elbow(df: DataFrame, columns: Sequence[str], ks: Sequence[int], max_iter: int = MAX_ITER) -> DataFrame:
    """Mean within-cluster difference for each number of modes."""
    fits = fit_all(df, columns, list(ks), max_iter)
    rows = [(int(k), sum(f.within) / len(f.within)) for k, f in fits.items()]
    return df.sparkSession.createDataFrame(rows, "modes int, mean_within double")
