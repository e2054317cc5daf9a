"""Densify counts to a full grid, pivot and unpivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, functions as F


def densify(
    counts: DataFrame,
    keys: Sequence[str],
    grid: Mapping[str, range],
    value: str,
    fill: int | float = 0,
    domain: DataFrame | None = None,
    keep_outside: bool = True,
) -> DataFrame:
    """Every key gets every grid cell; cells without a row carry ``fill``.

    ``counts`` has at most one row per key and cell. Rows outside the grid (a null hour, say)
    survive unless ``keep_outside`` is off. ``domain`` adds keys that have no row at all.

    No join: the cells of a key meet in one row (the grid bounds their number), the absent
    ordinals come from a set difference and are laid out again next to the present cells.
    """
    names = list(grid)
    sizes = [len(grid[n]) for n in names]
    strides = [prod(sizes[i + 1:]) for i in range(len(names))]
    inside, ordinal = F.lit(True), F.lit(0)
    for name, stride in zip(names, strides):
        r = grid[name]
        inside = inside & F.col(name).between(r[0], r[-1])
        ordinal = ordinal + (F.col(name).cast("int") - r[0]) * stride
    value_type = counts.schema[value].dataType

    def cell(at: Column, coordinates: list[Column], amount: Column) -> Column:
        parts = [at.cast("int").alias("_at")]
        parts += [c.cast("int").alias(n) for n, c in zip(names, coordinates)]
        return F.struct(*parts, amount.cast(value_type).alias(value))

    at = F.when(inside, ordinal)
    present = counts if keep_outside else counts.where(F.coalesce(inside, F.lit(False)))
    cells = present.select(
        *keys, cell(at, [F.col(n) for n in names], F.coalesce(F.col(value), F.lit(fill))).alias("_cell")
    )
    if domain is not None:
        extra = domain.select(*keys).distinct()
        cells = cells.unionByName(extra, allowMissingColumns=True)
    gathered = cells.groupBy(*keys).agg(F.collect_list("_cell").alias("_cells"))

    def empty(i: Column) -> Column:
        coordinates = [
            F.floor(i / stride).cast("int") % size + grid[n][0]
            for n, size, stride in zip(names, sizes, strides)
        ]
        return cell(i, coordinates, F.lit(fill))

    every = F.sequence(F.lit(0), F.lit(prod(sizes) - 1))
    absent = F.array_except(every, F.transform("_cells", lambda c: c["_at"]))
    full = gathered.select(*keys, F.inline(F.concat("_cells", F.transform(absent, empty))))
    return full.drop("_at")


def within_names(df: DataFrame, name: str, names: Sequence) -> DataFrame:
    """``df`` itself; reading a row whose ``name`` is not among ``names`` raises instead of losing it."""
    known = F.col(name).isNull() | F.col(name).isin(list(names))
    problem = F.raise_error(F.concat(F.lit(f"{name} outside its list: "), F.col(name).cast("string")))
    return df.withColumn(name, F.when(known, F.col(name)).otherwise(problem.cast(df.schema[name].dataType)))


#: Places that a word of a bit set holds.
WORD = 62


class BitSets:
    """Sets of values from a short list as a few long columns: ``prefix0``, ``prefix1``, ...

    Whole numbers have the places of their range, other values those of the list.
    """

    def __init__(self, names: Sequence):
        self.names = list(names)
        self.whole = all(isinstance(n, int) and not isinstance(n, bool) for n in self.names)
        self.low = min(self.names) if self.whole else 0
        span = max(self.names) - self.low + 1 if self.whole else len(self.names)
        self.words = range(-(-span // WORD))

    def gathered(self, name: str, prefix: str) -> list[Column]:
        """Aggregates that put the values of a column together."""
        place = F.col(name) - self.low if self.whole else F.array_position(F.array(*[F.lit(n) for n in self.names]), F.col(name)) - 1
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))
        word = F.floor(place / WORD)
        return [F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0).cast("long")).alias(f"{prefix}{w}") for w in self.words]

    def has(self, name, prefix: str) -> Column:
        """Whether a value is in the set; whole numbers outside the range are not."""
        place = name - self.low if self.whole else self.names.index(name)
        if place // WORD not in self.words:
            return F.lit(False)
        return F.getbit(F.col(f"{prefix}{place // WORD}"), F.lit(place % WORD)) == 1


def pivot_presence(df: DataFrame, ids: Sequence[str], name: str, names: Sequence) -> DataFrame:
    """One 0/1 column per value of ``name``: does the id have that value? A value outside ``names`` raises.

    What is aggregated and shuffled is a bit set; columns are laid out at the end.
    """
    sets = BitSets(names)
    found = within_names(df, name, names).groupBy(*ids).agg(*sets.gathered(name, "_set"))
    return found.select(*ids, *[sets.has(n, "_set").cast("int").alias(str(n)) for n in names])


def pivot_values(
    df: DataFrame, ids: Sequence[str], name: str, names: Sequence, value: str, fill=None
) -> DataFrame:
    """One column per value of ``name``; the names are given, so no extra job looks for them."""
    wide = df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.fillna(fill, subset=[str(n) for n in names])


def pivot_many(
    df: DataFrame, ids: Sequence[str], name: str, names: Sequence, values: Sequence[str]
) -> DataFrame:
    """Several value columns at once, named ``value_name``."""
    aggs = [F.first(v, ignorenulls=True).alias(v) for v in values]
    if len(values) == 1:
        wide = df.groupBy(*ids).pivot(name, list(names)).agg(*aggs)
        return wide.withColumnsRenamed({f"{n}": f"{values[0]}_{n}" for n in names})
    wide = df.groupBy(*ids).pivot(name, list(names)).agg(*aggs)
    return wide.withColumnsRenamed({f"{n}_{v}": f"{v}_{n}" for n in names for v in values})


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name="name", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def drop_matching(df: DataFrame, fragment: str) -> DataFrame:
    """Drop every column whose name contains ``fragment``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if fragment not in c])


def by_position(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Columns ``start`` to ``stop`` (1-based, inclusive)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start - 1:stop]])


def expand_repeats(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    names: Sequence,
    first: str,
    repeat: str,
    times: str,
    fill=None,
    block: int = 4096,
) -> DataFrame:
    """Wide table with one row per occurrence, the unnested form of a pivot with repeated cells.

    ``df`` has one row per id and ``name`` with the cell's value at its ``first`` occurrence, at
    every later one (``repeat``) and how many ``times`` it occurs. Row i of an id shows the i-th
    occurrence; a cell that occurs once (or never, then it holds ``fill``) is repeated down the
    rows, one that occurs fewer than i but several times shows null.

    Runs stay counts until the end: no list of occurrences is ever collected, and long runs are
    laid out in blocks that spread over tasks. So do an id's cells: those it has are one list, and
    columns are laid out last, when rows are neither sorted nor shuffled any more.
    """
    df = within_names(df, name, names)
    name_type = df.schema[name].dataType
    known, n = F.col(name).isNotNull(), F.col(times).cast("long")
    packed = F.struct(F.col(name).alias("name"), F.col(first).alias("a"), F.col(repeat).alias("b"), n.alias("n"))
    gathered = df.groupBy(*ids).agg(
        F.collect_list(F.when(known, packed)).alias("_cells"), F.greatest(F.max(F.when(known, n)), F.lit(1)).alias("_rows")
    )
    blocks = gathered.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_rows") - 1) / block))))
    spread = blocks.repartition(*ids, "_block")
    start = F.col("_block") * block + 1
    rows = spread.withColumn(
        "occurrence", F.explode(F.sequence(start, F.least(start + block - 1, F.col("_rows"))))
    )
    place = [F.array_position("_cells.name", F.lit(v).cast(name_type)).cast("int") - 1 for v in names]
    laid_out = rows.select(*ids, "occurrence", *[F.get("_cells", at).alias(str(v)) for v, at in zip(names, place)])
    i = F.col("occurrence")
    shown = [
        F.when(c.isNull(), F.lit(fill)).when((i == 1) | (c["n"] == 1), c["a"]).when(i <= c["n"], c["b"]).alias(str(v))
        for v, c in ((v, F.col(f"`{v}`")) for v in names)
    ]
    return laid_out.select(*ids, "occurrence", *shown)
