"""Where intermediate results live.

Iterative operators cut their lineage in the checkpoint folder the session names
(``spark.checkpoint.dir``), so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach; where none is set, one beside the warehouse in a local-mode session."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _remove_at_end(spark, path)
    return path


def _remove_at_end(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
        _remove_at_end(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into the session's full number of shuffle partitions.

    For work that is heavy per byte (task code over small rows): a stated number is not merged
    into fewer partitions the way a plain shuffle of little data is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
