"""Delimited text in and out. Schemas are given, so no extra pass guesses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import decimal_comma

SEGMENT_INPUT = "customer_key bigint, secs int, week_day string"
CLEAN_DURATIONS = "date date, customer_key bigint, product_key bigint, msec double"
COUNTRIES = "user_country string, region string"
HABIT_PEAKS = (
    "customer_key bigint, day_mode string, time_1 int, wss_1 int, time_2 int, wss_2 int, time_3 int, wss_3 int"
)
BAND_SHARES = "afternoon double, early_morning double, midday double, morning double, night double"

# Quotes are doubled; spaces around a value belong to it; an empty text is "", a null is NA.
_DIALECT = {
    "nullValue": "NA", "escape": '"', "quote": '"', "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Comma-separated file(s) with a header; NA is null, text keeps its line breaks and outer spaces.

    A text that is just NA reads back as null, and a file is one task: the writers make one per partition.
    """
    return spark.read.schema(schema).options(header=True, sep=sep, multiLine=True, **_DIALECT).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma, decimal point, null as NA; one file per partition."""
    df.write.mode(mode).options(header=True, **_DIALECT).csv(path)


def write_csv_european(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Semicolon and decimal comma, as European spreadsheets expect."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    columns = [
        decimal_comma(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, fractional) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    df.select(*columns).write.mode(mode).options(header=True, sep=";", **_DIALECT).csv(path)


def read_csv_european(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back what :func:`write_csv_european` wrote."""
    wanted = T.StructType.fromDDL(schema)
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    as_text = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, fractional) else f.dataType) for f in wanted
    ])
    raw = read_csv(spark, path, as_text, sep=";")
    return raw.select(*[
        F.replace(F.col(f"`{f.name}`"), F.lit(","), F.lit(".")).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, fractional) else F.col(f"`{f.name}`")
        for f in wanted
    ])
