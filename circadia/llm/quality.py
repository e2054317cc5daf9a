"""Quality rules: counts of each text, and robust multivariate outliers per language and source.

Counts become a vector (word length, symbols, repeated lines, repeated words; see ``VECTOR``). Per
language and source the minimum-covariance-determinant estimate of centre and spread is found by
concentration steps over all rows: distances from the current estimate, the nearest half of the rows,
their mean and covariance, again until nothing changes. Half is what leaves the estimate alone up to
the largest share of junk that any such estimate bears. Three starts are followed (medians with
quartile spreads, all rows, and medians with median deviations, which bear as much junk), the one with
the smallest determinant counts. Where estimates come round again, the one with the smallest
determinant of the round counts. A text whose squared Mahalanobis distance is beyond the chi-square
quantile is rejected.

Every step is an aggregation: rows are summed by group and distance class first, so a group of any
size is a few hundred rows when its classes are put in order. Vectors are fixed-point numbers and
sums are exact, so the estimate does not depend on how rows are laid out. The nearest rows are taken
in whole distance classes (eight to a doubling), hence at least half of them. A group of at most
``TASK_VECTORS`` different vectors takes its steps in one task, which holds them; only larger ones
need jobs for every step, which cost the driver plans and threads.

Languages and sources with fewer than ``MIN_ROWS`` rows share the estimate of the small ones of their
language, and if those are too few, of all of them; a remainder that is too small rejects nothing.

Defined results: null text has no words and fails the base rule; null language or source are values of
their own; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from circadia.session import cut_lineage

from .storage import held
from .text import Words, mixed, slices, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """True bytes of each text."""
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(running[places])


def duplicate_lines(found: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, by text."""
    data, places = found.data, found.places
    texts = len(places) - 1
    if not len(data):
        return np.zeros(texts, np.int64)
    breaks = np.flatnonzero(data == 10)
    # a line is what stands between breaks and text ends; the break itself is cut off below
    begin = np.unique(np.concatenate([breaks + 1, places[:-1]]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10))
    worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, begin)
    begin, end = begin[worded], end[worded]
    if not len(begin):
        return np.zeros(texts, np.int64)
    text = np.searchsorted(places, begin, "right") - 1
    cuts = np.stack([begin, end], 1).ravel()
    cuts = np.append(cuts, len(data)) if cuts[-1] != len(data) else cuts
    column = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    lines = column.take(pa.array(np.arange(len(begin)) * 2)).dictionary_encode()
    code = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    different = np.unique(text * (len(lines.dictionary) + 1) + code) // (len(lines.dictionary) + 1)
    return np.bincount(text, minlength=texts) - np.bincount(different, minlength=texts)


def repeated_words(found: Words, window: int = WINDOW) -> np.ndarray:
    """Words in windows that their text holds twice or more, by text."""
    texts, total = len(found.first) - 1, len(found.start)
    flags = np.zeros(total + 1, np.int64)
    text = found.text
    last = found.first[1:][text] - window  # last window start of the word's text
    at = np.flatnonzero(np.arange(total) <= last)
    if len(at):
        of, _ = found.coded()
        with np.errstate(over="ignore"):
            key = mixed(text[at].astype(np.uint64))
            for k in range(window):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + of[at + k].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        a, b = at[order[:-1]], at[order[1:]]
        same = key[order[:-1]] == key[order[1:]]
        a, b = a[same], b[same]
        exact = text[a] == text[b]
        for k in range(window):
            exact &= of[a + k] == of[b + k]
        hit = np.unique(np.concatenate([a[exact], b[exact]]))
        np.add.at(flags, hit, 1)
        np.add.at(flags, hit + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(flags)[:total] > 0)])
    return np.diff(covered[found.first])


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, over all of it."""
    found = words(texts)
    inside = np.zeros(len(found.data), np.int64)
    np.add.at(inside, found.start, 1)
    ends = found.end[found.end < len(found.data)]
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside) > 0
    return {
        "n_words": np.diff(found.first),
        "word_chars": _per_text(inside & ((found.data & 0xC0) != 0x80), found.places),
        "n_symbols": _per_text(SYMBOLS[found.data], found.places),
        "n_dup_lines": duplicate_lines(found),
        "n_repeat_words": repeated_words(found),
    }


def counted(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (a struct of the ``carry`` columns), lang, source and the counts of each text."""
    inner = "text" in carry
    chosen = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        *([] if inner else [F.col("text").cast("string").alias("text")]),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field("text") if inner else batch.column(3)
            flat = pa.RecordBatch.from_arrays([*batch.columns[:3], text], names=["row", "lang", "source", "text"])
            for part in slices([flat], "text"):
                found = counts(part.column(3))
                numbers = [pa.array(found[name], pa.int64()) for name in COUNTS]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *numbers], names=["row", "lang", "source", *COUNTS])

    schema = chosen.select("row", "lang", "source", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    return chosen.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Fixed-point units in one.
UNIT = 1024
#: Each component, and the standard deviation that is added to its spread: below it, differences mean nothing.
VECTOR = (
    # mean word length on a log scale, drawn towards five by twenty words
    ("log2((word_chars + 100) / (n_words + 20))", 0.06),
    ("log2(1 + 100 * n_symbols / greatest(n_words, 1))", 0.5),
    ("log2(1 + n_dup_lines)", 0.7),
    ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.15),
)
DIMENSIONS = len(VECTOR)
MIN_ROWS = 50
COVERAGE = 0.5
TAIL = 1e-6
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
_ESTIMATE = "part string, start int, rows long, mean array<double>, precision array<double>, log_det double"


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return low


def _with_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"x{i}": F.round(F.expr(e) * UNIT).cast("long") for i, (e, _) in enumerate(VECTOR)})


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from the estimate that it was joined with."""
    d = [F.col(f"x{i}") / UNIT - F.col("mean")[i] for i in range(DIMENSIONS)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col("precision")[i * DIMENSIONS + j] for i, j in _PAIRS]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def _solved(part: pd.Series, start: pd.Series, n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Estimates from means and covariances, floored and scaled to be consistent for normal rows."""
    q = chi_square_quantile(COVERAGE, DIMENSIONS)
    cov = cov * np.where(start.to_numpy() >= 0, COVERAGE / chi_square(q, DIMENSIONS + 2), 1.0)[:, None, None]
    cov = cov + np.diag([floor**2 for _, floor in VECTOR])
    return pd.DataFrame({
        "part": part, "start": start.astype("int32"), "rows": n.astype("int64"), "mean": list(mean),
        "precision": list(np.linalg.inv(cov).reshape(len(n), -1)), "log_det": np.linalg.slogdet(cov)[1],
    })


def _from_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for sums in batches:
        n = sums["n"].to_numpy(np.float64)
        mean = np.stack([sums[f"s{i}"].to_numpy(np.float64) for i in range(DIMENSIONS)], 1) / n[:, None]
        cov = np.empty((len(n), DIMENSIONS, DIMENSIONS))
        for i, j in _PAIRS:
            # exact numerators: the products of sums may pass 64 bits
            exact = [
                (int(p) * int(k) - int(a) * int(b)) / (int(k) * int(k))
                for p, k, a, b in zip(sums[f"p{i}{j}"], sums["n"], sums[f"s{i}"], sums[f"s{j}"])
            ]
            cov[:, i, j] = cov[:, j, i] = exact
        yield _solved(sums["part"], sums["start"], n, mean / UNIT, cov / UNIT**2)


def _from_quartiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        q = np.stack([np.stack(rows[f"q{i}"].to_numpy()) for i in range(DIMENSIONS)], 1) / UNIT
        cov = np.zeros((len(rows), DIMENSIONS, DIMENSIONS))
        for i in range(DIMENSIONS):
            cov[:, i, i] = ((q[:, i, 2] - q[:, i, 0]) / 1.349) ** 2
        yield _solved(rows["part"], rows["start"], rows["n"].to_numpy(), q[:, :, 1], cov)


def _from_deviations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        middle = np.stack([np.stack(rows[name].to_numpy()) for name in ("middle", "off")], 1) / UNIT
        cov = np.zeros((len(rows), DIMENSIONS, DIMENSIONS))
        for i in range(DIMENSIONS):
            cov[:, i, i] = (middle[:, 1, i] / 0.6745) ** 2
        yield _solved(rows["part"], rows["start"], rows["n"].to_numpy(), middle[:, 0], cov)


def _sums() -> list[Column]:
    n = F.col("times")
    return [
        F.sum(n).alias("n"),
        *[F.sum(n * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMENSIONS)],
        *[F.sum(n * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS],
    ]


#: Parts whose estimates may be sent to all tasks (some 300 bytes each).
FEW_PARTS = 4096
#: Vectors that make a task worth starting.
TASK_ROWS = 100_000
#: Different vectors of a part (some 50 bytes each) that one task may hold for all its steps.
TASK_VECTORS = 200_000


def _sent(df: DataFrame, few: bool) -> DataFrame:
    """``df``, of a row or three per part, for a join: sent to all tasks if there are few parts."""
    return F.broadcast(df) if few else df


def _in_few_tasks(df: DataFrame, few: bool) -> DataFrame:
    """Three rows per part, of few parts, are a small table: not a task per shuffle partition."""
    return df.coalesce(2) if few else df


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step of every part and start."""
    far = F.floor(8 * F.log2(_distance() + 2.0**-20)).cast("int")
    classes = rows.join(estimate, "part").groupBy("part", "start", far.alias("far")).agg(*_sums())
    order = Window.partitionBy("part", "start").orderBy("far")
    nearer = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = F.sum("n").over(Window.partitionBy("part", "start"))
    near = classes.withColumn("_near", nearer < F.ceil(COVERAGE * everything)).where("_near")
    names = [c for c in near.columns if c not in ("part", "start", "far", "_near")]
    sums = near.groupBy("part", "start").agg(*[F.sum(c).alias(c) for c in names])
    return sums.mapInPandas(_from_sums, _ESTIMATE)


def _followed(moved: DataFrame, before: DataFrame, restart: bool, few: bool) -> DataFrame:
    """``moved`` with what is known of its way: ``mark`` of the estimate, ``stone`` (the mark at the last
    restart), ``best`` (since then) and ``done``: it stands still, or has come back to the stone."""
    own = F.struct("log_det", "rows", "mean", "precision")
    known = before.select("part", "start", F.col("mark").alias("_last"), F.col("stone").alias("_stone"), F.col("best").alias("_best"))
    joined = moved.withColumn("mark", F.xxhash64("rows", "mean", "precision")).join(_sent(known, few), ["part", "start"])
    still, back = F.col("mark") == F.col("_last"), F.col("mark") == F.col("_stone")
    best = F.when(still, own).otherwise(F.least("_best", own))
    return joined.select(
        *moved.columns, "mark",
        (F.col("mark") if restart else F.col("_stone")).alias("stone"),
        (F.when(back, best).otherwise(own) if restart else best).alias("best"),
        F.coalesce(still | back, F.lit(False)).alias("done"),
    )


def _added(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums per group."""
    total = np.zeros(groups, np.int64)
    np.add.at(total, group, values)
    return total


def _near_sums(vectors: np.ndarray, times: np.ndarray, estimate: pd.Series, start: int) -> pd.DataFrame:
    """One row of sums over the nearest classes of a part, as ``_concentrated`` has them."""
    d = [vectors[i] / UNIT - estimate["mean"][i] for i in range(DIMENSIONS)]
    distance = 0.0
    for i, j in _PAIRS:
        distance = distance + (1 if i == j else 2) * d[i] * d[j] * estimate["precision"][i * DIMENSIONS + j]
    _, far = np.unique(np.floor(8 * (np.log(distance + 2.0**-20) / np.log(2.0))), return_inverse=True)
    rows = _added(times, far, int(far.max()) + 1)
    near = (np.cumsum(rows) - rows < math.ceil(COVERAGE * int(rows.sum())))[far]
    x, n = vectors[:, near], times[near]
    sums = {"n": n.sum()} | {f"s{i}": (n * x[i]).sum() for i in range(DIMENSIONS)}
    sums |= {f"p{i}{j}": (n * x[i] * x[j]).sum() for i, j in _PAIRS}
    return pd.DataFrame([{"part": estimate["part"], "start": start} | sums])


def _settled(vectors: np.ndarray, times: np.ndarray, estimate: pd.Series, max_steps: int) -> pd.Series | None:
    """The estimate where the steps from this one stand still, or the best of the round they come back to."""
    known = lambda e: (e["rows"], tuple(e["mean"]), tuple(e["precision"]))
    order = lambda e: (e["log_det"], *known(e))
    start, last, stone, best = int(estimate["start"]), None, None, None
    for step in range(1, max_steps + 1):
        sums = _near_sums(vectors, times, estimate, start)
        own = next(_from_sums(iter([sums]))).iloc[0]
        if known(own) == last:
            return own
        best = own if best is None or order(own) < order(best) else best
        if known(own) == stone:
            return best
        if step & (step - 1) == 0:
            stone, best = known(own), own
        estimate, last = own, known(own)
    return None


def _in_one_task(rows: DataFrame, starts: DataFrame, max_steps: int) -> DataFrame:
    """part, start and best of parts that a task can hold; a start that is not settled has no best."""
    named = [f"x{i}" for i in range(DIMENSIONS)]
    kind = pa.struct({"log_det": pa.float64(), "rows": pa.int64(), "mean": pa.list_(pa.float64()), "precision": pa.list_(pa.float64())})

    def settle(vectors: pa.Table, starts: pa.Table) -> pa.Table:
        values, times = np.stack([vectors.column(c).to_numpy() for c in named]), vectors.column("times").to_numpy()
        given = [pd.Series(start) for start in starts.to_pylist()]
        found = [_settled(values, times, start, max_steps) for start in given]
        best = [None if e is None else {f.name: np.asarray(e[f.name]).tolist() for f in kind} for e in found]
        return pa.table({
            "part": pa.array([e["part"] for e in given], pa.string()), "start": pa.array([e["start"] for e in given], pa.int32()),
            "best": pa.array(best, kind),
        })

    met = rows.select("part", "times", *named).groupBy("part").cogroup(starts.select("part", "start", "mean", "precision").groupBy("part"))
    return met.applyInArrow(settle, "part string, start int, best struct<log_det: double, rows: bigint, mean: array<double>, precision: array<double>>")


def estimates(rows: DataFrame, max_steps: int = 200, task_vectors: int = 0) -> DataFrame:
    """The estimate of every part: mean, precision (inverse covariance) and rows it rests on.

    ``rows`` has part, x0, x1, ... and, where equal vectors are one row, how many ``times`` they occur. Each start goes on until it stands still. Classes of equal distance
    can make it go round: a stone is laid at steps 1, 2, 4, 8, ..., and a start that comes back to its
    stone has been all the way round. One that has done neither after ``max_steps`` raises. Parts of at
    most ``task_vectors`` rows go through the same steps in one task each.
    """
    if "times" not in rows.columns:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    quartiles = rows.groupBy("part").agg(
        F.lit(-1).alias("start"), F.sum("times").alias("n"),
        *[F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75), times)").alias(f"q{i}") for i in range(DIMENSIONS)],
        F.count("*").alias("vectors"),
    )
    quartiles = cut_lineage(quartiles)
    parts, large = quartiles.agg(F.count("*"), F.count_if(F.col("vectors") > task_vectors)).first()
    few = parts <= FEW_PARTS
    whole = rows.groupBy("part").agg(F.lit(-2).alias("start"), *_sums())
    middles = quartiles.select("part", F.array(*[F.col(f"q{i}")[1] for i in range(DIMENSIONS)]).alias("middle"))
    off = [F.expr(f"percentile(abs(x{i} - middle[{i}]), 0.5, times)") for i in range(DIMENSIONS)]
    deviations = rows.join(_sent(middles, few), "part").groupBy("part").agg(F.lit(-3).alias("start"), F.sum("times").alias("n"), F.array(*off).alias("off"))
    starts = [
        quartiles.mapInPandas(_from_quartiles, _ESTIMATE), whole.mapInPandas(_from_sums, _ESTIMATE),
        deviations.join(_sent(middles, few), "part").mapInPandas(_from_deviations, _ESTIMATE),
    ]
    current = starts[0].unionByName(starts[1]).unionByName(starts[2]).withColumn("start", -1 - F.col("start"))
    current = _in_few_tasks(current, few)
    unknown = F.lit(None).cast("struct<log_det: double, rows: bigint, mean: array<double>, precision: array<double>>")
    nothing = F.lit(None).cast("long")
    current = cut_lineage(current.withColumns({"mark": nothing, "stone": nothing, "best": unknown}))
    finished = []
    if large < parts:
        small, begun = rows, current
        if large:
            sizes = _sent(quartiles.select("part", (F.col("vectors") <= task_vectors).alias("_small")), few)
            rows, current = rows.join(sizes, "part"), current.join(sizes, "part")
            small, begun = rows.where("_small"), current.where("_small")
            rows, current = (df.where("not _small").drop("_small") for df in (rows, current))
        settled = cut_lineage(_in_one_task(small, begun, max_steps))
        if settled.where("best is null").limit(1).count():
            raise RuntimeError(f"estimates still change after {max_steps} steps")
        finished.append(settled)
    for step in range(1, max_steps + 1 if large else 1):
        moved = _in_few_tasks(_concentrated(rows, _sent(current.select("part", "start", "mean", "precision"), few)), few)
        followed = cut_lineage(_followed(moved, current, restart=step & (step - 1) == 0, few=few))
        left, ended = followed.agg(F.count_if(~F.col("done")), F.count_if("done")).first()
        if ended:
            finished.append(followed.where("done").select("part", "start", "best"))
        current = followed.where("not done")
        if not left:
            break
    else:
        if large:
            raise RuntimeError(f"estimates still change after {max_steps} steps")
    if not finished:
        finished = [current.where("false").select("part", "start", "best")]
    ends = finished[0]
    for more in finished[1:]:
        ends = ends.unionByName(more)
    best = ends.groupBy("part").agg(F.min_by("best", F.struct("best.log_det", "start")).alias("_e"))
    return best.select("part", "_e.mean", "_e.precision", "_e.rows")


def parted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``: their language and source, or a pool of those too small to estimate."""
    own = F.to_json(F.struct(F.lit("own").alias("kind"), "lang", "source"))
    pool = F.to_json(F.struct(F.lit("language").alias("kind"), "lang"))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("_small", F.col("n") < MIN_ROWS).withColumn("_own", own).withColumn("_pool", pool)
    pools = sizes.where("_small").groupBy("lang").agg((F.sum("n") < MIN_ROWS).alias("_tiny"))
    part = F.when(~F.col("_small"), F.col("_own")).when(~F.col("_tiny"), F.col("_pool")).otherwise(F.lit("rest"))
    named = sizes.alias("s").join(pools.alias("p"), F.expr("s.lang <=> p.lang"), "left")
    named = named.select(F.col("s.lang").alias("_lang"), F.col("s.source").alias("_source"), part.alias("part"))
    joined = rows.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.drop("_lang", "_source")


def judged(docs: DataFrame, carry: list[str], tail: float = TAIL) -> DataFrame:
    """row (the ``carry`` columns), the counts, base_failed, distance (null if base_failed) and kept."""
    rows = held(counted(docs, carry).withColumn("base_failed", base_failed()), "quality-counts")
    good = rows.where("not base_failed").select("lang", "source", *COUNTS)
    named = [f"x{i}" for i in range(DIMENSIONS)]
    # equal vectors are one row: copies, and texts without symbols or repeats, are often equal
    vectors = _with_vector(parted(good)).groupBy("part", "lang", "source", *named).agg(F.count("*").alias("times"))
    vectors = held(vectors, "quality")
    found = cut_lineage(estimates(vectors.coalesce(1 + vectors.count() // TASK_ROWS), task_vectors=TASK_VECTORS))
    parts = vectors.select("part", F.col("lang").alias("_lang"), F.col("source").alias("_source")).distinct()
    known = cut_lineage(parts.join(_sent(found, found.count() <= FEW_PARTS), "part"))
    known = _sent(known, known.count() <= FEW_PARTS)
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    measured = _with_vector(rows.join(known, same & ~F.col("base_failed"), "left"))
    limit = chi_square_quantile(1 - tail, DIMENSIONS)
    measured = measured.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    enough = F.col("rows") >= F.lit(MIN_ROWS * COVERAGE)
    kept = ~F.col("base_failed") & ((F.col("distance") <= limit) | ~enough)
    return measured.withColumn("kept", F.coalesce(kept, F.lit(False))).select(
        "row", "lang", "source", *COUNTS, "base_failed", "distance", "kept"
    )


def filtered(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones; all columns as they are."""
    return judged(docs, docs.columns).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
