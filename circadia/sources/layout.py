"""Tables laid out once by day and by key, so that what reads them neither scans other days nor shuffles by that key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Layout:
    """A Parquet table in days, each day hashed by ``key`` into the same number of buckets.

    ``schema`` lists the columns without ``day``, which is an int. Bucketing by a raw key sends all rows of a key of one
    day to one file: store counts or other rows that are bounded per key, not events of a key that may be a third of them.
    """

    path: str
    schema: str
    day: str
    key: str
    buckets: int

    def register(self, spark: SparkSession, name: str | None = None) -> str:
        """Name of the table in this session; days already at ``path`` are found again."""
        name = name or f"layout_{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(
            f"CREATE TABLE {name} ({self.schema}, {self.day} INT) USING parquet PARTITIONED BY ({self.day}) "
            f"CLUSTERED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.catalog.recoverPartitions(name)
        return name

    def replace_days(self, table: str, rows: DataFrame, days: Sequence[int] | None = None) -> None:
        """Puts ``rows`` in place of the days they hold; a second call with the same rows changes nothing.

        ``days`` names what the call stands for: rows of other days are left out, and a named day without
        rows becomes empty. Rows without a day are not stored, as no look-back would find them.
        """
        spark = rows.sparkSession
        rows = rows.where(F.col(self.day).isNotNull())
        if days is not None:
            wanted = sorted(set(days))
            rows = rows.where(F.col(self.day).isin(wanted))
            stored = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
            old = [d for d in wanted if f"{self.day}={d}" in stored]
            filled = {r[0] for r in rows.where(F.col(self.day).isin(old)).select(self.day).distinct().collect()} if old else set()
            columns = [c for c in spark.table(table).columns if c != self.day]
            nothing = rows.select(*columns).where(F.lit(False))
            for day in set(old) - filled:
                spark.sql(f"INSERT OVERWRITE {table} PARTITION ({self.day}={day}) SELECT * FROM {{nothing}}", nothing=nothing)
        # one task per bucket, so a day has one file per bucket
        placed = rows.select(*spark.table(table).columns).repartition(self.buckets, self.key)
        with _set(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):  # an option of the writer is ignored here
            placed.write.insertInto(table, overwrite=True)
        spark.catalog.refreshTable(table)


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
