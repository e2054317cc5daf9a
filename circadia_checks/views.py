"""Input views of the analyses over the test tables (see FIXTURES.md), as DataFrames."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-31"
SINCE_START, SINCE_RECENT = 20240101, 20240115


class Views:
    """Lazily built views of one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _event_keys(self):
        ts, user = F.col("ts"), F.col("user_id")
        date_key = (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")
        customer = F.when(user % 50 == 0, F.lit(-1)).otherwise(user).cast("bigint")
        product = F.get_json_object("props", "$.k").cast("int")
        return date_key, customer, product

    def reader_fact(self) -> DataFrame:
        ts, event = F.col("ts"), F.col("event_id")
        date_key, customer, product = self._event_keys()
        secs = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        return self.table("events").select(
            "event_id",
            date_key.alias("date_key"),
            customer.alias("customer_key"),
            F.when(event % 97 == 0, F.lit(-1)).otherwise(secs).cast("int").alias("time_of_day_key"),
            F.when(event % 41 == 0, F.lit(-1)).otherwise(product).cast("int").alias("product_key"),
        )

    def time_of_day(self) -> DataFrame:
        i = F.col("id").cast("int")
        part = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
        text = F.concat_ws(":", part(i / 3600), part((i / 60) % 60), part(i % 60))
        return self.spark.range(86400).select(i.alias("time_of_day_key"), text.alias("time_of_day"))

    def read_duration_fact(self) -> DataFrame:
        date_key, customer, product = self._event_keys()
        return self.table("events").select(
            date_key.alias("read_duration_date_key"),
            customer.alias("customer_key"),
            product.cast("bigint").alias("product_key"),
            F.round(F.col("value") * 60000).cast("bigint").alias("milliseconds_spent"),
        )

    def member(self) -> DataFrame:
        benefit = F.when(F.col("c_custkey") % 3 == 0, "No").otherwise("Yes")
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("email"), benefit.alias("streaming_benefit")
        )

    def product(self) -> DataFrame:
        ebook = F.col("p_type").isin("ECONOMY", "STANDARD", "SMALL")
        return self.table("part").select(
            F.col("p_partkey").alias("product_key"),
            F.col("p_name").alias("title"),
            F.when(ebook, "E-bøger").otherwise("Lydbøger").alias("type"),
            F.when(F.col("p_type") == "PROMO", "Fys").otherwise("Dig").alias("type_group"),
        )

    def product_theme_bridge(self) -> DataFrame:
        part = self.table("part")
        key = F.col("p_partkey").alias("product_key")
        own = part.where(F.col("p_size") % 7 != 0).select(key, F.col("p_size").alias("thema_category_key"))
        second = part.where(F.col("p_partkey") % 10 == 0).select(key, (F.col("p_size") + 1).alias("thema_category_key"))
        return own.unionByName(second)

    def theme_category(self) -> DataFrame:
        size = F.col("p_size")
        tag = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
        group = F.when(size % 3 == 0, "Skønlitteratur").when(size % 3 == 1, "Faglitteratur")
        return self.table("part").select("p_size").distinct().select(
            size.alias("thema_category_key"),
            tag("Bøger|T", size % 10).alias("level1_danish"),
            tag("Books|T", size % 10).alias("level1_english"),
            tag("N", size).alias("name_english"),
            group.alias("category_group"),
            tag("C", size % 5).alias("category"),
        )

    def product_genre(self) -> DataFrame:
        key = F.col("p_partkey")
        genre = F.when(key % 3 == 0, "Fagbøger").when(key % 3 == 1, "Skønlitteratur")
        return self.table("part").where(key % 11 != 0).select(key.alias("product_key"), genre.alias("genre_level1"))

    def bucket_fact(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        day = F.col("o_orderdate")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("customer_key"),
            F.col("l_partkey").alias("product_key"),
            # spread over all 100 buckets
            ((F.col("l_orderkey") + 17 * F.col("l_linenumber")) % 100 + 1).cast("int").alias("read_bucket_key"),
            (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int").alias("date_key"),
            F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(1).alias("premium_key"),
        )

    def read_bucket(self) -> DataFrame:
        number = F.col("id").cast("int")
        return self.spark.range(1, 101).select(number.alias("read_bucket_key"), number.alias("bucket_no"))

    def bucket_product(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_key"),
            F.col("p_type").alias("title"),
            # three isbn per title
            F.concat(F.lit("I-"), "p_type", F.lit("-"), (F.col("p_partkey") % 3).cast("string")).alias("isbn13"),
            F.when(F.col("p_size") % 2 == 0, "E-bøger").otherwise("Lydbøger").alias("type"),
        )

    def game_events(self) -> DataFrame:
        people = self.table("customer").select("c_custkey", "c_nationkey")
        name = F.when(F.col("event_type") == "signup", "gameStarted").otherwise(F.col("event_type"))
        return self.table("events").join(people, F.col("user_id") == F.col("c_custkey")).select(
            name.alias("event_name"),
            F.col("ts").alias("event_timestamp"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("user_country"),
        )

    def countries(self) -> DataFrame:
        return self.table("nation").where(F.col("n_nationkey") < 20).select(
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("user_country"),
            F.col("n_name").alias("region"),
        )

    def habit_peaks(self) -> DataFrame:
        k = F.col("c_custkey")
        day = (
            F.when(k % 17 == 0, F.lit(None).cast("string"))
            .when(k % 7 == 0, "Sunday").when(k % 7 == 1, "Monday").when(k % 7 == 2, "Saturday").otherwise("Friday")
        )
        none1 = k % 13 == 0
        none2 = none1 | (k % 3 == 0)
        none3 = none2 | (k % 4 != 0)
        number = lambda hidden, value: F.when(~hidden, value).cast("int")
        return self.table("customer").select(
            k.alias("customer_key"),
            day.alias("day_mode"),
            number(none1, (k * 2711) % 36000).alias("time_1"),
            number(none1, 1 + k % 5).alias("wss_1"),
            number(none2, 45000 + (k * 3967) % 38000).alias("time_2"),
            number(none2, 1 + (k * 3) % 5).alias("wss_2"),
            number(none3, 60000 + (k * 1543) % 26000).alias("time_3"),
            number(none3, 1 + (k * 7) % 5).alias("wss_3"),
        )


@cache
def views(spark: SparkSession, folder: str) -> Views:
    return Views(spark, folder)
