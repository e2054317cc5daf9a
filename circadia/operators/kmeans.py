"""k-means on numeric columns: fits, stable cluster numbers, elbow curve, automatic k, replicates.

Values are fixed-point numbers and sums are exact, so a fit does not depend on how rows are laid out. Equal
rows collapse to one with a count. A round is one pass for *all* fits under way (every k of an elbow, every
replicate): each task assigns its rows to the centres of every fit and sends one row per centre, these are
added up by Spark, and only centres (k x columns per fit) reach the driver. Where few rows are left, one task holds them
and goes through the same rounds at once. A fit ends when no centre
moves by more than a tolerance; its centres are those whose sum of squares the last pass has measured. Each round that
moves a centre lowers the sum of squares, so every fit ends; it is given the rounds that it needs.

Late rounds move centres little, and only rows about as far from a second centre as from their own can change sides. A
pass counts rows by their margin, the second-least less the least distance. A bounded number of rows with small margins
then go to one task per fit, which takes round after round with them and the exact totals of all rows until centres
have moved so far that a row left out might change sides; then the next pass follows. Centres are the same as by passes alone.

Starts come from a bounded sample, the rows with the smallest checksums: the first of them, then each time the one
that is farthest from the chosen ones. When k is estimated, a fit of k + 1 centres starts from those found for k and a
row of the sample out of the cluster with the largest sum of squares.

Cluster numbers are 1-based and follow the sorted centres. Rows with a null feature take no part and have no cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .sampling import in_split

# Task code travels with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed-point units in one.
UNIT = 1 << 32
#: Movement of a centre's coordinate that counts as none.
TOLERANCE = 1e-4
#: Rows that starts are chosen from.
START_ROWS = 2048
#: Collapsed rows that make a task worth starting.
TASK_ROWS = 20_000
#: Numbers in the rows of small margin that one task may hold for a fit.
NEAR_VALUES = 1_000_000
#: Steps of its centres that a fit is followed for with rows of small margin.
NEAR_STEPS = 64
#: Margins are counted in classes, four to a doubling, from 2 ** -20 to 2 ** 10.
_CLASSES = range(-80, 40)
#: Relative error that distances are far from having.
_SLIGHT = 1e-12
#: Rows whose distances to all centres are laid out at a time.
_BLOCK = 2048
_EXACT = "decimal(38,0)"


def _fixed(c: str) -> Column:
    return F.round(F.col(c).cast("double") * UNIT)


def _distance(values: Sequence[Column], center: Sequence[float]) -> Column:
    return reduce(Column.__add__, [(v - F.lit(float(x))) ** 2 for v, x in zip(values, center)])


def _number_of_nearest(values: Sequence[Column], centers: Sequence[Sequence[float]]) -> Column:
    ranked = F.array(*[_distance(values, c) for c in centers])
    return F.array_position(ranked, F.array_min(ranked)).cast("int")


@dataclass
class Fit:
    """A fitted clustering over named columns; centres are sorted."""

    columns: list[str]
    centers: list[list[float]]
    wss: float

    @property
    def k(self) -> int:
        return len(self.centers)

    def assign(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """Add the number of the nearest centre to each row (the first one on a tie)."""
        return df.withColumn(name, _number_of_nearest([_fixed(c) / UNIT for c in self.columns], self.centers))

    def table(self, spark: SparkSession, number: str = "centroid") -> DataFrame:
        """Centres as rows, one column per feature."""
        schema = f"{number} int, " + ", ".join(f"`{c}` double" for c in self.columns)
        return spark.createDataFrame([(i + 1, *c) for i, c in enumerate(self.centers)], schema)


@dataclass
class _State:
    """A fit under way: its centres, and what the last pass measured with them."""

    part: int
    centers: np.ndarray
    cluster_wss: list[int] = field(default_factory=list)
    moved: bool = True
    rounds: int = 0
    # of the last pass: the centres it measured, their rows and sums, and the margin below which rows may be followed
    measured: np.ndarray | None = None
    totals: tuple[list[int], list[list[int]]] | None = None
    reach: float = 0.0

    @property
    def wss(self) -> float:
        return sum(self.cluster_wss) / UNIT

    def fit(self, columns: Sequence[str]) -> Fit:
        return Fit(list(columns), sorted([float(x) for x in c] for c in self.centers), self.wss)


def _added(weight: np.ndarray, value: np.ndarray, group: np.ndarray, groups: int) -> list[int]:
    """Exact sums of weight times value per group, by upper and lower digits."""
    out = []
    for digits in (value >> 24, value & ((1 << 24) - 1)):
        total = np.zeros(groups, np.int64)
        np.add.at(total, group, weight * digits)
        out.append(total.tolist())
    return [(high << 24) + low for high, low in zip(*out)]


def _nearest(values: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest centre (the first one on a tie), squared distance and margin, a little less than it is."""
    own, least, margin = np.empty(len(values), np.int64), np.empty(len(values)), np.empty(len(values))
    for at in range(0, len(values), _BLOCK):
        block = slice(at, at + _BLOCK)
        real = values[block] / UNIT
        distance = np.zeros((len(real), len(centers)))
        for j in range(values.shape[1]):
            distance += (real[:, j, None] - centers[None, :, j]) ** 2
        every = np.arange(len(real))
        own[block] = distance.argmin(1)
        least[block] = distance[every, own[block]]
        distance[every, own[block]] = np.inf
        margin[block] = np.sqrt(distance.min(1)) * (1 - _SLIGHT) - np.sqrt(least[block]) * (1 + _SLIGHT)
    return own, least, margin


def _totals(values: np.ndarray, weight: np.ndarray, own: np.ndarray, k: int) -> tuple[list[int], list[list[int]]]:
    """Rows and sums of each column (in units) of each centre's rows."""
    rows = np.zeros(k, np.int64)
    np.add.at(rows, own, weight)
    return rows.tolist(), [_added(weight, values[:, j], own, k) for j in range(values.shape[1])]


def _squared(weight: np.ndarray, least: np.ndarray, own: np.ndarray, k: int) -> list[int]:
    """Sum of squares (in units) of each centre's rows."""
    whole = np.floor(least)
    rest = np.rint((least - whole) * UNIT).astype(np.int64)
    return [a * UNIT + b for a, b in zip(_added(weight, whole.astype(np.int64), own, k), _added(weight, rest, own, k))]


def _moved(centers: np.ndarray, rows: Sequence[int], sums: Sequence[Sequence[int]]) -> np.ndarray:
    """Means of the centres' rows; a centre without rows stays."""
    out = centers.copy()
    for c, n in enumerate(rows):
        if n:
            out[c] = [((2 * s[c] + n) // (2 * n)) / UNIT for s in sums]
    return out


def _far(moved: np.ndarray, centers: np.ndarray) -> bool:
    return bool((np.abs(moved - centers) > TOLERANCE).any())


def _drift(moved: np.ndarray, centers: np.ndarray) -> float:
    """The most that a row's margin may have shrunk: two centres have moved, its own and another."""
    paths = np.sqrt(((moved - centers) ** 2).sum(1))
    return float(np.sort(paths)[-2:].sum() * (1 + _SLIGHT))


def _coded(number: int) -> int:
    """A class of margins as a number that no centre has, and back."""
    return -1000 - number


def _reach(classes: dict[int, int], most: int) -> float:
    """The largest class limit that at most ``most`` rows have a margin below."""
    reach, rows = 0.0, 0
    for c in _CLASSES:
        rows += classes.get(c, 0)
        if rows > most:
            break
        reach = 2.0 ** ((c + 1) / 4)
    return reach


def _followed(
    values: np.ndarray, weight: np.ndarray, centers: np.ndarray, limit: int | None,
    totals: tuple[list[int], list[list[int]]] | None = None, reach: float = np.inf,
) -> tuple[np.ndarray, int, bool]:
    """The centres after as many rounds as these rows allow, the rounds, and whether centres still move.

    ``totals`` are those of all rows with ``centers``; rows that are not here have a margin of at least ``reach``.
    """
    first, k = centers, len(centers)
    own, _, lasts = _nearest(values, centers)
    rows, sums = totals or _totals(values, weight, own, k)
    spent, rounds = 0.0, 0
    while True:
        moved = _moved(centers, rows, sums)
        if not _far(moved, centers):
            return centers, rounds, False
        rounds += 1
        if rounds == limit:
            return moved, rounds, True
        spent += _drift(moved, centers)
        centers = moved
        if _drift(centers, first) >= reach:
            return centers, rounds, True
        # rows whose margin may be used up
        open_ = np.flatnonzero(lasts <= spent * (1 + _SLIGHT))
        new, _, margin = _nearest(values[open_], centers)
        lasts[open_] = margin + spent
        crossed = new != own[open_]
        at = open_[crossed]
        gone, come = (_totals(values[at], weight[at], to, k) for to in (own[at], new[crossed]))
        rows = [t - a + b for t, a, b in zip(rows, gone[0], come[0])]
        sums = [[t - a + b for t, a, b in zip(*column)] for column in zip(sums, gone[1], come[1])]
        own[at] = new[crossed]


@dataclass
class _Rows:
    """Collapsed rows: x0, x1, ... in units, ``n`` and a bit per part that they belong to, in ``tasks`` partitions."""

    table: DataFrame
    columns: list[str]
    tasks: int

    @property
    def names(self) -> list[str]:
        return [f"x{j}" for j in range(len(self.columns))]

    def settle(self, states: Sequence[_State], max_iter: int | None) -> None:
        """Rounds for all states together until none moves."""
        open_ = list(states)
        if self.tasks == 1:
            self._inside(states, max_iter)
            open_ = [s for s in states if s.moved]
        while open_:
            if max_iter is not None and any(s.rounds >= max_iter for s in open_):
                raise RuntimeError(f"centres still move after {max_iter} rounds: {[len(s.centers) for s in open_]} centres")
            self._pass_over(open_)
            open_ = [s for s in open_ if s.moved]
            # a margin that a few steps use up is not worth a task
            near = [s for s in open_ if s.reach > 4 * _drift(s.centers, s.measured)]
            if near:
                self._follow(near, max_iter)

    def _pass_over(self, states: Sequence[_State]) -> None:
        """Measure all states in one aggregation and move their centres; ``moved`` says whether any did."""
        names, given = ["n", *self.names, "wss"], [(s.part, s.centers) for s in states]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {(fit, c): [0] * len(names) for fit, (_, centers) in enumerate(given) for c in range(len(centers))}
            margins = {}
            for batch in batches:
                *xs, n, parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                values = np.stack(xs, 1)
                for fit, (part, centers) in enumerate(given):
                    inside = (parts >> part) & 1 == 1
                    own, least, margin = _nearest(values[inside], centers)
                    rows, sums = _totals(values[inside], n[inside], own, len(centers))
                    for c, measured in enumerate(zip(rows, *sums, _squared(n[inside], least, own, len(centers)))):
                        total[fit, c] = [a + b for a, b in zip(total[fit, c], measured)]
                    low, high = _CLASSES[0], _CLASSES[-1] + 1
                    classes = np.floor(4 * np.log2(np.clip(margin, 2.0 ** (low / 4), 2.0 ** (high / 4))))
                    for c, rows in zip(*np.unique(np.clip(classes, low, high).astype(np.int64), return_counts=True)):
                        key = (fit, _coded(int(c)))
                        margins[key] = margins.get(key, 0) + int(rows)
            made = [(*key, *map(Decimal, sums)) for key, sums in total.items() if sums[0]]
            made += [(*key, Decimal(rows), *[Decimal(0)] * (len(names) - 1)) for key, rows in margins.items()]
            kinds = [pa.int32(), pa.int32(), *[pa.decimal128(38, 0)] * len(names)]
            columns = [pa.array([r[j] for r in made], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["fit", "cluster", *names])

        schema = ", ".join(["fit int", "cluster int", *[f"{c} {_EXACT}" for c in names]])
        found = self.table.mapInArrow(measure, schema).groupBy("fit", "cluster").agg(*[F.sum(c) for c in names])
        totals = {tuple(r[:2]): list(map(int, r[2:])) for r in found.collect()}
        for fit, state in enumerate(states):
            rows, *sums, wss = zip(*[totals.get((fit, c), [0] * len(names)) for c in range(len(state.centers))])
            state.cluster_wss = list(wss)
            moved = _moved(state.centers, rows, sums)
            state.moved = _far(moved, state.centers)
            state.rounds += 1
            if state.moved:
                most = NEAR_VALUES // (len(self.columns) + 2)
                margins = {_coded(at): n[0] for (f, at), n in totals.items() if f == fit and at < 0}
                step = _drift(moved, state.centers)
                state.reach = min(_reach(margins, most), NEAR_STEPS * step) if len(moved) > 1 else 0.0
                state.measured, state.totals = state.centers, (list(rows), [list(s) for s in sums])
                state.centers = moved

    def _follow(self, states: Sequence[_State], max_iter: int | None) -> None:
        """Rounds with the rows of small margin only, a task per state, for as long as the others surely stay."""
        given = [(s.part, s.measured, s.reach) for s in states]
        known = [(s.measured, None if max_iter is None else max_iter - s.rounds + 1, s.totals, s.reach) for s in states]
        names = [*self.names, "n"]

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *xs, parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                values = np.stack(xs, 1)
                for fit, (part, centers, reach) in enumerate(given):
                    inside = values[(parts >> part) & 1 == 1]
                    near = inside[_nearest(inside[:, :-1], centers)[2] < reach]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), fit, np.int32)), *map(pa.array, near.T)], names=["fit", *names])

        def go(rows: pa.Table) -> pa.Table:
            fit = rows.column("fit")[0].as_py()
            values = np.stack([rows.column(c).to_numpy() for c in names], 1)
            centers, rounds, _ = _followed(values[:, :-1], values[:, -1], *known[fit])
            return pa.table({
                "fit": pa.array([fit], pa.int32()), "rounds": pa.array([rounds], pa.int32()),
                "centers": pa.array([centers.tolist()], pa.list_(pa.list_(pa.float64()))),
            })

        rows = self.table.mapInArrow(chosen, ", ".join(["fit int", *[f"{c} long" for c in names]]))
        # a stated number of partitions is not merged: fits are long work on few bytes
        own = rows.repartition(len(states), "fit").groupBy("fit")
        for fit, rounds, centers in own.applyInArrow(go, "fit int, rounds int, centers array<array<double>>").collect():
            states[fit].centers = np.array(centers)
            # the first of them is the pass's own
            states[fit].rounds += max(rounds - 1, 0)

    def _inside(self, states: Sequence[_State], max_iter: int | None) -> None:
        """The same rounds where one task holds all rows (at most ``TASK_ROWS``), without a job for each."""
        given = [(s.part, s.centers) for s in states]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
            *xs, n, parts = [np.concatenate(c) for c in zip(*columns)]
            values, made = np.stack(xs, 1), []
            for fit, (part, centers) in enumerate(given):
                inside = (parts >> part) & 1 == 1
                values_, weight = values[inside], n[inside]
                centers, rounds, going = _followed(values_, weight, centers, max_iter)
                nearest, least, _ = _nearest(values_, centers)
                wss = _squared(weight, least, nearest, len(centers))
                made += [(fit, c, list(centers[c]), Decimal(wss[c]), rounds, going) for c in range(len(centers))]
            kinds = {
                "fit": pa.int32(), "cluster": pa.int32(), "center": pa.list_(pa.float64()), "wss": pa.decimal128(38, 0),
                "rounds": pa.int32(), "moved": pa.bool_(),
            }
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in made], kind) for j, kind in enumerate(kinds.values())], names=list(kinds))

        found = self.table.mapInArrow(go, f"fit int, cluster int, center array<double>, wss {_EXACT}, rounds int, moved boolean").collect()
        for fit, state in enumerate(states):
            own = sorted((r for r in found if r["fit"] == fit), key=lambda r: r["cluster"])
            state.centers = np.array([r["center"] for r in own])
            state.cluster_wss = [int(r["wss"]) for r in own]
            state.rounds, state.moved = state.rounds + own[0]["rounds"], own[0]["moved"]

    def samples(self, parts: int, seed: int) -> list[np.ndarray]:
        """For each part at most ``START_ROWS`` distinct rows, those with the smallest checksums first."""
        checksum = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in self.names]))
        chosen = [
            self.table.where(F.getbit("parts", F.lit(part)) == 1).select(F.lit(part).alias("part"), *self.names, checksum.alias("_at"))
            .orderBy("_at", *self.names).limit(START_ROWS)
            for part in range(parts)
        ]
        found = reduce(DataFrame.unionByName, chosen).toPandas().sort_values(["part", "_at", *self.names])
        return [found.loc[found["part"] == part, self.names].drop_duplicates().to_numpy(np.int64) / UNIT for part in range(parts)]


@contextmanager
def _collapsed(df: DataFrame, columns: Sequence[str], parts: Sequence[Column] = ()) -> Iterator[_Rows]:
    """The rows without a null in ``columns``, equal ones together, held in memory and on disk while passes go over them."""
    member = reduce(Column.bitwiseOR, [F.when(p, 1 << i).otherwise(0).cast("long") for i, p in enumerate(parts)]) if parts else F.lit(1).cast("long")
    known = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))
    fixed = known.select(*[_fixed(c).cast("long").alias(f"x{j}") for j, c in enumerate(columns)], member.alias("parts"))
    names = [f"x{j}" for j in range(len(columns))]
    counted = cut_lineage(fixed.groupBy(*names, "parts").agg(F.count("*").alias("n")).select(*names, "n", "parts"))
    # few rows are few tasks: a pass over them is all start-up; rows are small, so the shuffle may have left them in fewer
    tasks = max(-(-counted.count() // TASK_ROWS), 1)
    held = (counted.coalesce(1) if tasks == 1 else counted.repartition(tasks)).persist()
    try:
        yield _Rows(held, list(columns), tasks)
    finally:
        held.unpersist()


def _squares(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points))
    for j in range(points.shape[1]):
        out += (points[:, j] - center[j]) ** 2
    return out


def _far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """The first row, then each time the one that is farthest from those chosen; fewer than k if there are fewer."""
    chosen, nearest = [0], _squares(sample, sample[0])
    while len(chosen) < k and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _squares(sample, sample[chosen[-1]]))
    return sample[chosen]


def _more(state: _State, sample: np.ndarray) -> np.ndarray | None:
    """The centres and a row of the worst cluster that has one of the sample apart from its centre."""
    distance = np.stack([_squares(sample, c) for c in state.centers], 1)
    nearest = distance.argmin(1)
    least = distance[np.arange(len(sample)), nearest]
    for worst in sorted(range(len(state.centers)), key=lambda c: -state.cluster_wss[c]):
        own = np.where(nearest == worst, least, 0)
        if own.max() > 0:
            return np.concatenate([state.centers, sample[[int(own.argmax())]]])
    return None


def _known(samples: Sequence[np.ndarray]) -> None:
    if not all(map(len, samples)):
        raise ValueError("no rows to cluster")


def fit_each(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 62, max_iter: int | None = None) -> list[Fit]:
    """One fit per k; all of them go over the rows together. Fewer centres if there are fewer distinct rows."""
    with _collapsed(df, columns) as rows:
        samples = rows.samples(1, seed)
        _known(samples)
        starts = _far_apart(samples[0], max(ks))
        states = {k: _State(0, starts[:k]) for k in ks}
        rows.settle(list(states.values()), max_iter)
    return [states[k].fit(columns) for k in ks]


def fit(df: DataFrame, columns: Sequence[str], k: int, seed: int = 62, max_iter: int | None = None) -> Fit:
    """k centres; fewer if the data has fewer distinct points."""
    return fit_each(df, columns, [k], seed, max_iter)[0]


def elbow(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 62, max_iter: int | None = None) -> DataFrame:
    """Total within-cluster sum of squares for each k."""
    rows = [(int(k), found.wss) for k, found in zip(ks, fit_each(df, columns, ks, seed, max_iter))]
    return df.sparkSession.createDataFrame(rows, "centroids int, wss double")


def gain_cutoff(rows: int, columns: int) -> float:
    """Smallest relative drop of the sum of squares that justifies one more cluster."""
    return min(0.02 + 10.0 / rows + 2.5 / columns**2, 0.8)


def _estimated(rows: _Rows, samples: Sequence[np.ndarray], k_max: int, cutoffs: Sequence[float], max_iter: int | None) -> list[Fit]:
    """For each part the fit with the last cluster that lowered its sum of squares enough.

    The parts take their decisions on their own, but share every pass.
    """
    best: dict[int, Fit] = {}
    open_ = {part: _State(part, sample[:1]) for part, sample in enumerate(samples)}
    while open_:
        rows.settle(list(open_.values()), max_iter)
        for part, state in list(open_.items()):
            found, before = state.fit(rows.columns), best.get(part)
            if before is not None and 1 - found.wss / before.wss <= cutoffs[part]:
                del open_[part]
                continue
            best[part] = found
            more = _more(state, samples[part]) if found.k < k_max and found.wss > 0 else None
            if more is None:
                del open_[part]
            else:
                open_[part] = _State(part, more)
    return [best[part] for part in range(len(samples))]


def _estimates(
    df: DataFrame, columns: Sequence[str], parts: Sequence[Column], k_max: int, seed: int, cutoff: float | None, max_iter: int | None
) -> list[Fit]:
    with _collapsed(df, columns, parts) as rows:
        count = max(len(parts), 1)
        samples = rows.samples(count, seed)
        _known(samples)
        sizes = rows.table.agg(*[F.sum(F.getbit("parts", F.lit(p)) * F.col("n")) for p in range(count)]).first()
        cutoffs = [gain_cutoff(n, len(columns)) if cutoff is None else cutoff for n in sizes]
        return _estimated(rows, samples, k_max, cutoffs, max_iter)


def estimate_k(
    df: DataFrame, columns: Sequence[str], k_max: int, seed: int = 62, cutoff: float | None = None, max_iter: int | None = None
) -> Fit:
    """Add clusters while each one lowers the sum of squares enough."""
    return _estimates(df, columns, (), k_max, seed, cutoff, max_iter)[0]


#: Replicates that share the passes; a row's memberships are bits of one number.
MOST_REPLICATES = 60


def stability(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    replicates: int = 10,
    k_max: int = 3,
    ratio: float = 0.75,
    seed: int = 62,
    max_iter: int | None = None,
) -> DataFrame:
    """Centres found on repeated random parts of the rows, all parts in the same passes.

    The parts of replicate r are those of ``split`` with seed + r; more than ``MOST_REPLICATES`` go in turns.
    """
    found = []
    for first in range(1, replicates + 1, MOST_REPLICATES):
        numbers = range(first, min(first + MOST_REPLICATES, replicates + 1))
        parts = [in_split(keys, ratio, seed + r) for r in numbers]
        for r, fitted in zip(numbers, _estimates(df, columns, parts, k_max, seed, None, max_iter)):
            found += [(r, i, *c) for i, c in enumerate(fitted.centers, start=1)]
    schema = "replicate int, centroid int, " + ", ".join(f"`{c}` double" for c in columns)
    return df.sparkSession.createDataFrame(found, schema)


def nearest(df: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]], name: str = "cluster") -> DataFrame:
    """Number of the nearest given centre (the first one on a tie), as a plain expression."""
    return df.withColumn(name, _number_of_nearest([F.col(c) for c in columns], centers))


def read_centers(table: DataFrame, columns: Sequence[str], number: str = "centroid", limit: int = 1000) -> list[list[float]]:
    """Centres of a centre table, in number order. Refuses tables that are not a few centres."""
    rows = table.select(number, *columns).orderBy(number).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} centres")
    return [[float(r[c]) for c in columns] for r in rows]


def cluster_spread(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Sum of squared distances to the own cluster's mean, per cluster."""
    spread = sum((F.var_pop(c) for c in columns), F.lit(0.0)) * F.count("*")
    return df.groupBy(cluster).agg(F.count("*").alias("n"), spread.alias("wss"))
