"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from circadia.session import scratch_path

__all__ = ["held", "picked", "read_documents", "scratch_path", "ship", "width"]

_ROOT = Path(__file__).resolve().parents[2]


def held(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: work is done once and survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which whoever runs the job sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per session, unless their Python finds it anyway."""
    context = spark.sparkContext
    system = context._jvm.System
    known = (system.getenv("PYTHONPATH") or "").split(os.pathsep) + [system.getProperty("user.dir")]
    if str(_ROOT) in known or getattr(context, "_circadia_sent", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="circadia-code-"), "circadia_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("circadia/__init__.py", "")  # packages without this file are not found in archives
        for file in sorted((_ROOT / "circadia").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    context.addPyFile(path)
    context._circadia_sent = True


def read_documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under our own names, whatever else the table holds."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])
