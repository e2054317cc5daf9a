"""Join shapes of the analyses. Broadcast or shuffle is left to Spark's own size checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def semi_on_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the key table; the keys never leave the cluster."""
    return df.join(keys.select(*on), list(on), "left_semi")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null; the key columns appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in on])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in on]
    rest = [F.col(f"`{c}`") for c in left.columns if c not in on]
    rest += [F.col(f"`{c}`") for c in right.columns if c not in on]
    return joined.select(*keys, *rest)


def full_join_all(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Fold tables by full outer join on one key; all sides share one partitioning."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), tables)


def with_group_range(df: DataFrame, group: str, value: str, low: str = "m1", high: str = "m2") -> DataFrame:
    """Smallest and largest value of the group, next to each distinct group.

    Joining the range back to the rows and keeping distinct (group, range) rows leaves one row
    per group, so the aggregate alone is the answer.
    """
    return df.groupBy(group).agg(F.min(value).alias(low), F.max(value).alias(high))
