"""Tables by SQL text: over session views, or pushed to a database as a whole query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


def query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text; ``{name}`` in the text stands for the table passed under that name."""
    return spark.sql(text, **tables) if tables else spark.sql(text)


def database_reader(
    spark: SparkSession,
    url: str,
    text: str,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    options: Mapping[str, str] | None = None,
) -> DataFrameReader:
    """Reader for a query a database runs.

    With a split column the result is fetched by several tasks at once, each asking for its own
    range; without one a single task fetches everything.
    """
    reader = spark.read.format("jdbc").option("url", url)
    if split_column is None:
        reader = reader.option("query", text)
    else:
        low, high = bounds
        # A partitioned fetch takes a table expression, not a query.
        reader = (
            reader.option("dbtable", f"({text}) AS q")
            .option("partitionColumn", split_column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", partitions)
        )
    return reader.options(**(options or {}))


def database_query(spark: SparkSession, url: str, text: str, **kwargs) -> DataFrame:
    return database_reader(spark, url, text, **kwargs).load()


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Parquet tables of a folder, by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
