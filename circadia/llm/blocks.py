"""Dealing clusters of candidates to tasks: blocks of bounded weight, every pair of a cluster in some task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import width


def in_blocks(rows: DataFrame, cluster: str, weight: str, keys: list[str], block: int) -> DataFrame:
    """``rows`` with task, large, i, j, side: the rows of equal task, large, i and j belong together.

    A cluster of more than ``block`` weight is cut into blocks by a hash of the keys, and each pair of
    its blocks is a task; smaller clusters share tasks of about a block. ``side`` is 0 and 1 in a pair
    of blocks and 2 where a block meets itself. Memory is bounded; no pair of rows is written.
    """
    totals = rows.groupBy(cluster).agg(F.sum(weight).alias("_all"))
    joined = rows.join(totals, cluster)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_all") / F.lit(block))).cast("int")
    small = totals.where(F.col("_all") <= block).agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0]
    shared = max(1, -(-int(small) // block), min(width(rows.sparkSession), 1 + int(small) // (1 << 16)))
    mine = F.pmod(F.xxhash64(*keys), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j"))
    )
    dealt = joined.withColumn("_pair", F.explode(pairs)).withColumn("_blocks", blocks).withColumn("_mine", mine)
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64(cluster), F.lit(shared))).otherwise(F.col(cluster))
    side = F.when(F.col("_pair.i") == F.col("_pair.j"), 2).otherwise((F.col("_mine") == F.col("_pair.j")).cast("int"))
    return dealt.select(
        *rows.columns, task.alias("task"), (F.col("_blocks") > 1).alias("large"),
        F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"), side.cast("long").alias("side"),
    )
