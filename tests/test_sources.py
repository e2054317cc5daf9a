"""Files in and out, and the database reader's options."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from circadia import session
from circadia.functions.calendar import key_days_before, within_days
from circadia.sources import delimited, warehouse
from conftest import SMALL


def test_csv_round_trip_with_nulls_commas_and_quotes(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'a,"b"', 2.5), (2, None, None), (3, "ø;", -1.0)], "k int, s string, d double")
    delimited.write_csv(df, str(tmp_path / "x"))
    assert rows(delimited.read_csv(spark, str(tmp_path / "x"), df.schema)) == rows(df)


@pytest.mark.parametrize("european", [False, True])
def test_text_survives(spark, tmp_path, rows, european):
    texts = ["a\nb", "a\r\nb", " lead", "trail ", " ", "", None, 'q"uo"te', '"', ",", ";", "1,5", "\\", "\\n", "ø", "\t", "x\\"]
    df = spark.createDataFrame([(i, t, i + 0.25) for i, t in enumerate(texts)], "k int, s string, d double")
    path = str(tmp_path / "t")
    if european:
        delimited.write_csv_european(df, path)
        assert rows(delimited.read_csv_european(spark, path, "k int, s string, d double")) == rows(df)
    else:
        delimited.write_csv(df, path)
        assert rows(delimited.read_csv(spark, path, df.schema)) == rows(df)


def test_european_file_has_semicolons_and_decimal_commas(spark, tmp_path, rows):
    df = spark.createDataFrame([("Mandag", 1, 2.5), ("Søndag", 2, None)], "day string, n int, share double")
    path = tmp_path / "eu"
    delimited.write_csv_european(df.coalesce(1), str(path))
    lines = sorted(line for f in path.glob("*.csv") for line in Path(f).read_text(encoding="utf8").splitlines())
    assert lines == ["Mandag;1;2,5", "Søndag;2;NA", "day;n;share"]
    assert rows(delimited.read_csv_european(spark, str(path), "day string, n int, share double")) == rows(df)


def test_existing_output_is_not_overwritten(spark, tmp_path):
    delimited.write_csv(spark.range(3), str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        delimited.write_csv(spark.range(3), str(tmp_path / "once"))


def test_query_over_frames(spark):
    got = warehouse.query(spark, "SELECT sum(id) AS s FROM {t} WHERE id > 1", t=spark.range(4))
    assert got.first()["s"] == 5


class Recorder:
    """Stands in for a reader and notes its options."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **kwargs):
        self.seen.update(kwargs)
        return self


def test_database_options():
    stub = type("S", (), {"read": Recorder()})()
    warehouse.database_reader(stub, "jdbc:x", "SELECT 1")
    assert stub.read.seen == {"format": "jdbc", "url": "jdbc:x", "query": "SELECT 1"}
    stub = type("S", (), {"read": Recorder()})()
    warehouse.database_reader(stub, "jdbc:x", "SELECT k FROM t", "k", (1, 9), 4, {"fetchsize": "1000"})
    seen = stub.read.seen
    assert seen["dbtable"] == "(SELECT k FROM t) AS q" and seen["numPartitions"] == 4 and "query" not in seen
    assert (seen["partitionColumn"], seen["lowerBound"], seen["upperBound"], seen["fetchsize"]) == ("k", 1, 9, "1000")


def test_look_back_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.createDataFrame([(20240101,), (20240130,)], "date_key int").write.parquet(path)
    recent = spark.read.parquet(path).where(within_days(F.col("date_key"), "2024-01-31", 7))
    assert recent.count() == 1
    assert "GreaterThanOrEqual(date_key,20240124)" in recent._jdf.queryExecution().executedPlan().toString()


def test_look_back_counts_from_today_by_default(spark):
    got = spark.range(1).select(key_days_before(None, 0).alias("k")).first()["k"]
    assert abs((dt.date.today() - dt.datetime.strptime(str(got), "%Y%m%d").date()).days) <= 1


def test_scratch_folder_follows_the_session(spark):
    configured = spark.conf.get(session.CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    path = session.scratch_path(spark, "t")
    if configured:
        assert path.startswith(configured.rstrip("/"))
    assert session.scratch_path(spark, "t") != path


def test_small_tables_by_name(spark):
    assert set(warehouse.tables(spark, SMALL, "nation", "region")) == {"nation", "region"}
