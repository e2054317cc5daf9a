"""Repeatable samples: membership depends on the key and the seed, not on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_DIGITS = 12  # hexadecimal digits of the checksum that place a key


def _checksum(keys: Sequence[str], seed: int) -> Column:
    """A checksum of seed and key values as text; null has a text of its own."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _position(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) fixed by the key values and the seed."""
    number = F.conv(F.substring(_checksum(keys, seed), 1, _DIGITS), 16, 10).cast("long")
    return number / float(1 << 4 * _DIGITS)


def sample_keys(df: DataFrame, keys: Sequence[str], n: int, seed: int = 62) -> DataFrame:
    """n random distinct keys, as a distributed top-n on a checksum."""
    distinct = df.select(*keys).distinct()
    return distinct.orderBy(_checksum(keys, seed), *keys).limit(n)


def sample_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 62) -> DataFrame:
    return df.where(_position(keys, seed) < fraction)


def in_split(keys: Sequence[str], ratio: float = 0.75, seed: int = 62) -> Column:
    """Whether a key is in the first part of ``split``."""
    return _position(keys, seed) < ratio


def split(df: DataFrame, keys: Sequence[str], ratio: float = 0.75, seed: int = 62) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that add up to the table."""
    low = in_split(keys, ratio, seed)
    return df.where(low), df.where(~low)
