"""Every operator and analysis as a named query over the test tables.

analyses carry their function's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from circadia.functions import calendar as cal, clock, semantics as sem, text
from circadia.operators import density, grid, joins, kmeans, peaks, ranking, sampling, scaling, sketches, stats
from circadia.plans import activity, completion, densities, events as ev, habits, rhythm, segments, usage
from circadia.session import scratch_path
from circadia.sources import delimited, warehouse

from .views import AS_OF, SINCE_RECENT, SINCE_START, Views, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums taken in another order compare equal."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(build(views(spark, folder)))

    QUERIES[build.__name__] = run
    return build


# ---- shared inputs -------------------------------------------------------------------------


def customer_events(v: Views) -> DataFrame:
    return ev.customer_events(v.reader_fact(), v.time_of_day(), AS_OF)


def segment_input(v: Views) -> DataFrame:
    return ev.segment_input(customer_events(v))


def themed(v: Views) -> DataFrame:
    return ev.themed(v.reader_fact(), v.product_theme_bridge(), v.theme_category(), v.time_of_day(), AS_OF)


def themed_week(v: Views) -> DataFrame:
    return ev.themed_week(v.reader_fact(), v.product_theme_bridge(), v.theme_category(), v.time_of_day(), AS_OF)


def clean(v: Views) -> DataFrame:
    return usage.clean_durations(v.read_duration_fact(), AS_OF)


def bucket_reads(v: Views) -> DataFrame:
    return completion.bucket_reads(
        v.bucket_fact(), v.read_bucket(), v.bucket_product(), product_type=None, premium_only=False
    )


def starts(v: Views) -> DataFrame:
    return densities.game_starts(v.game_events())


def content(v: Views) -> DataFrame:
    return segments.content_counts(ev.recent(v.reader_fact(), AS_OF, 60), v.product(), v.product_genre())


def profiles(v: Views) -> DataFrame:
    habits_ = segments.habit_type(v.habit_peaks())
    return segments.customer_profiles(habits_, segments.preferences(content(v)))


def bands(v: Views) -> DataFrame:
    return segments.band_share_features(segment_input(v))


def hours(v: Views) -> DataFrame:
    return segments.hour_share_features(segment_input(v))


def given_centroids(v: Views) -> DataFrame:
    """Centres that follow from the data alone: mean band shares of three fixed customer groups."""
    group = (F.col("customer_key") % 3 + 1).cast("int").alias("centroid")
    return bands(v).groupBy(group).agg(*[F.avg(b).alias(b) for b in clock.BAND_NAMES])


BUCKETS = completion.BUCKETS
CUSTOMERS = [1, 2, 3, 5, 8, 13, 21]
DAY = 86400


def per_day(curves: DataFrame) -> DataFrame:
    """Density per day instead of per second, which reads (and rounds) better."""
    return curves.withColumn("density", F.col("density") * DAY).drop("bandwidth")


# ---- sources and sinks ---------------------------------------------------------------------


@query
def src1_warehouse_query(v):
    return warehouse.query(
        v.spark,
        """SELECT date_key, count(*) AS n_events, count(DISTINCT customer_key) AS n_customers
           FROM {facts} WHERE date_key >= 20231217 GROUP BY date_key""",
        facts=v.reader_fact(),
    )


@query
def src2_event_scan(v):
    return warehouse.query(
        v.spark,
        "SELECT user_country, event_name, count(*) AS n, max(event_timestamp) AS latest FROM {log} GROUP BY ALL",
        log=v.game_events(),
    )


@query
def src3_snk1_csv_round_trip(v):
    path = scratch_path(v.spark, "segment-input")
    delimited.write_csv(segment_input(v), path)
    return delimited.read_csv(v.spark, path, delimited.SEGMENT_INPUT)


@query
def snk2_european_round_trip(v):
    path = scratch_path(v.spark, "weekday-hour-share")
    shares = activity.weekday_hour_share(v.reader_fact(), v.time_of_day(), AS_OF)
    delimited.write_csv_european(shares, path)
    return delimited.read_csv_european(
        v.spark, path, "weekday int, weekday_label string, hour int, share_pct double"
    )


# ---- projections and filters ---------------------------------------------------------------


@query
def prj1_select(v):
    return v.reader_fact().select("date_key", "customer_key")


@query
def prj2_drop(v):
    return v.product().drop("type", "type_group")


@query
def prj3_name_patterns(v):
    peaks_ = v.habit_peaks()
    times = grid.columns_starting(peaks_, "time")
    return grid.drop_matching(peaks_, "wss").select("customer_key", *times)


@query
def prj3_by_position(v):
    return grid.by_position(v.reader_fact(), 2, 3)


@query
def prj4_rename(v):
    return v.member().withColumnsRenamed({"customer_key": "key", "email": "address"})


@query
def prj5_derived_columns(v):
    return customer_events(v).select(
        "customer_key",
        "weekday",
        cal.weekday_label(F.col("weekday"), "short").alias("weekday_name"),
        cal.weekend_flag(F.col("weekday")).alias("weekend"),
        "secs",
        "hour",
    )


@query
def prj7_key_set(v):
    return ev.known_customers(v.reader_fact()).select(F.col("customer_key").alias("key")).distinct()


@query
def flt1_sentinels(v):
    fact = ev.known_customers(v.reader_fact()).where(F.col("product_key") > 0)
    return fact.select("event_id", "customer_key", "product_key")


@query
def flt2_look_back(v):
    fact = v.reader_fact()
    counts = [
        ev.recent(fact, AS_OF, d).groupBy("date_key").agg(F.count("*").alias("n")).withColumn("days", F.lit(d))
        for d in (7, 45, 60)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def flt3_cut_off(v):
    return ev.recent(v.reader_fact(), since=SINCE_RECENT).select("event_id", "date_key")


@query
def flt4_equality(v):
    wanted = (F.col("type") == "E-bøger") & (F.col("type_group") == "Dig") & (F.col("product_key") != 7)
    return v.product().where(wanted).select("product_key", "title")


@query
def flt5_members(v):
    return v.reader_fact().where(F.col("customer_key").isin(CUSTOMERS)).select("event_id", "customer_key")


@query
def flt6_not_in_keeps_null(v):
    return v.habit_peaks().where(sem.not_in(F.col("day_mode"), segments.WEEKEND)).select("customer_key", "day_mode")


@query
def flt7_drop_null(v):
    return themed(v).select("date_key", "secs", "category_group").dropna("any")


@query
def flt8_outliers_by_weekday(v):
    return stats.drop_outliers(customer_events(v), ["weekday"], "secs", "not_beyond", few_groups=True)


@query
def flt8_outliers_by_customer(v):
    return stats.drop_outliers(customer_events(v), ["customer_key"], "secs", "within")


@query
def flt8_outliers_wide(v):
    return stats.drop_outliers(customer_events(v), ["customer_key"], "secs", "within", width=3.0)


@query
def flt9_active_customers(v):
    return segments.active_customers(segment_input(v))


@query
def flt9_active_within_week(v):
    week = ev.customer_events(v.reader_fact(), v.time_of_day(), AS_OF, 7)
    return segments.active_customers(ev.segment_input(week))


@query
def clean_durations(v):
    return clean(v)


# ---- joins ---------------------------------------------------------------------------------


@query
def jon1_time_dimension(v):
    return v.reader_fact().join(v.time_of_day(), "time_of_day_key", "left").select("event_id", "time_of_day")


@query
def jon3_bucket_joins(v):
    return completion.bucket_reads(v.bucket_fact(), v.read_bucket(), v.bucket_product(), after=19950226)


@query
def jon4_digital_products(v):
    joined = v.reader_fact().join(v.product(), "product_key", "left").where(F.col("type_group") == "Dig")
    return joined.select("event_id", "product_key", "type")


@query
def jon6_semi_on_keys(v):
    keys = segments.active_customers(segment_input(v), 60)
    return joins.semi_on_keys(v.reader_fact(), keys, ["customer_key"]).select("event_id", "customer_key")


@query
def jon7_natural_inner(v):
    counts = content(v)
    return joins.null_safe_join(segments.format_preference(counts), segments.genre_preference(counts), ["customer_key"])


@query
def jon7_null_keys_match(v):
    left = v.habit_peaks().groupBy("day_mode").agg(F.count("*").alias("n"))
    right = v.habit_peaks().groupBy("day_mode").agg(F.max("customer_key").alias("last_customer"))
    return joins.null_safe_join(left, right, ["day_mode"])


@query
def jon8_countries_left(v):
    return densities.starts_by_country(v.countries(), starts(v)).select("user_country", "region", "secs")


@query
def jon9_mode_left(v):
    days = segments.modal_weekdays(segment_input(v))
    return joins.null_safe_join(v.member().select("customer_key", "email"), days, ["customer_key"], "left")


@query
def jon10_full_keys(v):
    days = segments.modal_weekdays(segment_input(v))
    everyone = v.member().where(F.col("streaming_benefit") == "Yes").select("customer_key")
    return joins.null_safe_join(days, everyone, ["customer_key"], "full")


@query
def jon11_full_fold(v):
    e = customer_events(v)
    tables = [
        e.groupBy("customer_key").agg(F.min("secs").alias("first_secs")),
        e.where(F.col("weekday") >= 6).groupBy("customer_key").agg(F.count("*").alias("n_weekend")),
        v.member().select("customer_key", "streaming_benefit"),
    ]
    return joins.full_join_all(tables, ["customer_key"])


@query
def jon13_bin_range(v):
    binned = scaling.interval_bin(customer_events(v), "secs", 24, "bin")
    return joins.with_group_range(binned, "bin", "secs").withColumn("hour1", clock.hour_of(F.col("m1")))


# ---- aggregates ----------------------------------------------------------------------------


@query
def agg1_count_by_keys(v):
    return customer_events(v).groupBy("customer_key", "weekday").agg(F.count("*").alias("n"))


@query
def agg2_buckets_per_customer(v):
    recent = ev.recent(v.reader_fact(), since=SINCE_START)
    return recent.groupBy("customer_key").agg(F.count("*").alias("n_buckets"))


@query
def agg3_whole_minutes(v):
    minutes = F.sum(clock.whole_minutes(F.col("milliseconds_spent")))
    return v.read_duration_fact().groupBy("customer_key").agg(minutes.alias("total_minutes"))


@query
def agg4_sum(v):
    return clean(v).groupBy("customer_key").agg(F.sum("msec").alias("msec"))


@query
def agg5_count_distinct(v):
    e = customer_events(v)
    return e.groupBy("weekday").agg(
        sem.count_distinct(F.col("hour")).alias("hours"),
        sem.count_distinct(F.col("hour"), count_null=False).alias("known_hours"),
    )


@query
def agg5_approximate_users(v):
    """Users per day and over all days from one stored sketch a day, beside the exact numbers."""
    e, error = ev.recent(v.reader_fact(), AS_OF, 45).where("customer_key <> -1").select("date_key", "customer_key"), sketches.distinct_error()
    daily = sketches.distinct_sketches(e, ["date_key"], ["customer_key"])
    whole = sketches.merged_distinct(daily, [], ["customer_key"])
    near = sketches.distinct_counts(daily, ["date_key"], ["customer_key"]).unionByName(
        sketches.distinct_counts(whole, [], ["customer_key"]).withColumn("date_key", F.lit(0)))
    users = F.count_distinct("customer_key").alias("users")
    exact = e.groupBy("date_key").agg(users).unionByName(e.agg(users).withColumn("date_key", F.lit(0)))
    return exact.join(near, "date_key").select(
        "date_key", "users", (F.abs(F.col("customer_key") - F.col("users")) <= error * F.col("users")).alias("within_error"))


@query
def agg6_approximate_cardinalities(v):
    """Every column's estimated distinct values, beside the exact ones; null counts as one."""
    table = v.theme_category().where(F.col("thema_category_key") > 0)
    error = sketches.distinct_error()
    exact = activity.column_cardinalities(table)
    near = activity.column_cardinalities(table, approximate=True).withColumnsRenamed({c: f"_{c}" for c in table.columns})
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n"), (F.abs(F.col(f"_{c}") - F.col(c)) <= error * F.col(c)).alias("within_error"))
        for c in table.columns
    ]
    # one row each
    return exact.withColumn("_one", F.lit(1)).join(near.withColumn("_one", F.lit(1)), "_one").select(F.inline(F.array(*cells)))


@query
def agg7_approximate_median(v):
    """Medians of prices by line number from a sketch per line number and shipping year: is their rank near one half?"""
    items = v.table("lineitem").select("l_linenumber", F.col("l_extendedprice").cast("double").alias("price"), F.year("l_shipdate").alias("year"))
    yearly = sketches.quantile_sketches(items, ["l_linenumber", "year"], "price")
    merged = sketches.merged_quantiles(yearly, ["l_linenumber"], "price")
    near = merged.select("l_linenumber", sketches.quantile("price").alias("median"))
    ranks = items.join(near, "l_linenumber").groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.avg((F.col("price") < F.col("median")).cast("int")).alias("below"),
        F.avg((F.col("price") <= F.col("median")).cast("int")).alias("upto"))
    near_half = (F.col("below") - 0.5 <= sketches.RANK_ERROR) & (0.5 - F.col("upto") <= sketches.RANK_ERROR)
    return ranks.select("l_linenumber", "n", near_half.alias("within_error"))


@query
def agg7_median(v):
    return stats.exact_median(v.table("lineitem"), ["l_linenumber"], "l_extendedprice")


@query
def agg8_standard_deviation(v):
    hist = stats.histogram(customer_events(v), ["customer_key"], "secs")
    return stats.median_and_sd(hist, ["customer_key"], "secs")


@query
def agg9_mean(v):
    return clean(v).groupBy("product_key").agg(F.avg("msec").alias("mean_msec"))


@query
def agg10_min_max(v):
    return joins.with_group_range(customer_events(v), "weekday", "secs", "first_secs", "last_secs")


@query
def agg11_mode(v):
    e = customer_events(v)
    own = stats.modal(e, ["customer_key"], "weekday", "mode_weekday")
    return own.withColumn("overall_mode", stats.modal(e, [], "weekday").scalar())


@query
def agg14_distinct_rows(v):
    return v.reader_fact().select("date_key", "customer_key").distinct()


@query
def agg15_distinct_keys(v):
    return v.reader_fact().select("customer_key").distinct()


@query
def agg16_first_row_per_key(v):
    fact = v.reader_fact().select("customer_key", "date_key", "time_of_day_key", "product_key")
    return ranking.first_row_per_key(fact, ["customer_key"])


@query
def agg17_row_and_group_counts(v):
    joined = densities.counted_by_country(v.countries(), starts(v))
    rows = F.sum(F.coalesce("n", F.lit(1).cast("long")))
    return joined.agg(rows.alias("n_rows"), F.count_distinct("region").alias("n_regions"))


# ---- windows, order, samples ---------------------------------------------------------------


@query
def win1_win2_share_of_group(v):
    counts = customer_events(v).groupBy("customer_key", "hour").agg(F.count("*").alias("n"))
    return ranking.share_of_group(counts, ["customer_key"], "n", "prop_n", total="sum_n")


@query
def win6_top_with_ties(v):
    counts = customer_events(v).groupBy("customer_key", "hour").agg(F.count("*").alias("n"))
    return ranking.top_with_ties(counts, ["customer_key"], "n", 2)


@query
def win7_gap_flags(v):
    return completion.gap_flags(bucket_reads(v))


@query
def win8_quantile_buckets(v):
    return ranking.quantile_bucket(v.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5, ["c_custkey"])


@query
def win8_quantile_buckets_null(v):
    peaks_ = v.habit_peaks().select("customer_key", "wss_1")
    return ranking.quantile_bucket(peaks_, "wss_1", 7, ["customer_key"])


@query
def win9_row_in_group(v):
    return ranking.number_within(v.product_theme_bridge(), ["product_key"], ["thema_category_key"])


@query
def srt1_sort(v):
    return ranking.sorted_rows(v.theme_category(), "category_group", "-thema_category_key")


@query
def srt2_top_with_ties(v):
    counts = v.reader_fact().groupBy("customer_key").agg(F.count("*").alias("n"))
    return ranking.top_n_with_ties(counts, "n", 10)


@query
def srt3_level_order(v):
    names = v.habit_peaks().groupBy("day_mode").agg(F.count("*").alias("n"))
    return names.withColumn("position", cal.weekday_ordinal(F.col("day_mode"))).orderBy("position")


@query
def srt4_last_rows(v):
    return ranking.last_rows(v.reader_fact().select("date_key", "event_id"), ["date_key", "event_id"], 6)


@query
def smp1_sample_keys(v):
    return sampling.sample_keys(v.reader_fact(), ["customer_key"], 30)


@query
def smp2_sample_fraction(v):
    return sampling.sample_fraction(v.reader_fact(), ["event_id"], 0.3).select("event_id", "customer_key")


@query
def smp3_split(v):
    train, rest = sampling.split(v.reader_fact().select("event_id"), ["event_id"])
    return train.withColumn("part", F.lit("train")).unionByName(rest.withColumn("part", F.lit("rest")))


@query
def set1_append(v):
    buckets = v.reader_fact().select("customer_key", F.lit("reads").alias("source"))
    spent = v.read_duration_fact().select("customer_key", F.lit("durations").alias("source"))
    both = buckets.unionByName(spent)
    return both.groupBy("customer_key", "source").agg(F.count("*").alias("n"))


# ---- reshaping -----------------------------------------------------------------------------


@query
def rsh2_pivot_counts(v):
    counts = habits.week_counts(customer_events(v)).groupBy("customer_key", "weekday").agg(F.sum("n").alias("n"))
    wide = grid.pivot_values(counts, ["customer_key"], "weekday", range(1, 8), "n", fill=0)
    return wide.withColumnsRenamed({str(d): f"d{d}" for d in range(1, 8)})


@query
def rsh3_densify(v):
    e = ev.timed(v.reader_fact(), v.time_of_day(), ["product_key"])
    counts = e.groupBy("product_key", "hour").agg(F.count("*").alias("n"))
    return grid.densify(counts, ["product_key"], {"hour": range(24)}, "n")


@query
def rsh3_densify_inside(v):
    e = ev.timed(v.reader_fact(), v.time_of_day(), ["product_key"])
    counts = e.groupBy("product_key", "hour").agg(F.count("*").alias("n"))
    everything = v.product().select(F.col("product_key").cast("int").alias("product_key"))
    return grid.densify(counts, ["product_key"], {"hour": range(24)}, "n", domain=everything, keep_outside=False)


@query
def rsh4_pivot_many(v):
    long = v.habit_peaks().select(
        "customer_key",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("centroid"), F.col(f"time_{i}").alias("time"), F.col(f"wss_{i}").alias("wss"))
            for i in (1, 2, 3)
        ])),
    )
    return grid.pivot_many(long.where("time IS NOT NULL"), ["customer_key"], "centroid", [1, 2, 3], ["time", "wss"])


@query
def rsh5_unpivot(v):
    return grid.to_long(v.habit_peaks(), ["customer_key"], ["time_1", "time_2", "time_3"])


@query
def rsh6_bucket_rows(v):
    return _numbered(completion.bucket_rows(bucket_reads(v), BUCKETS))


@query
def rsh6_bucket_gap_rows(v):
    return _numbered(completion.bucket_gap_rows(bucket_reads(v), BUCKETS))


# ---- functions -----------------------------------------------------------------------------


@query
def fn1_4_calendar(v):
    key = F.col("date_key")
    date = cal.date_of_key(key)
    weekday = cal.iso_weekday(date)
    return v.reader_fact().select(
        "event_id",
        date.alias("date"),
        cal.key_of_date(date).alias("key_again"),
        weekday.alias("weekday"),
        cal.weekday_label(weekday, "short").alias("name_short"),
        cal.weekday_label(weekday, "english").alias("name_english"),
        cal.weekday_label(weekday, "danish").alias("name_danish"),
        cal.weekend_flag(weekday).alias("weekend"),
        cal.day_class(cal.weekday_label(weekday)).alias("day_class"),
    )


@query
def fn5_12_clock(v):
    ts, secs = F.col("event_timestamp"), clock.seconds_of_timestamp(F.col("event_timestamp"))
    return v.game_events().select(
        "event_timestamp",
        F.hour(ts).alias("hour"),
        F.minute(ts).alias("minute"),
        F.second(ts).alias("second"),
        secs.alias("secs"),
        clock.hour_of(secs).alias("hour_of_secs"),
        clock.clock_text(secs).alias("clock"),
        clock.seconds_of_text(clock.clock_text(secs)).alias("secs_again"),
        clock.round_to_step(secs, 2).alias("even_secs"),
        ((secs > clock.at("05:30:00")) & (secs < clock.at("10:00:00"))).alias("is_commute"),
    )


@query
def fn13_time_bands(v):
    band = clock.time_band(F.col("hour"))
    e = customer_events(v).select("hour", band.alias("band"), clock.band_ordinal(band).alias("band_order"))
    return e.groupBy("hour", "band", "band_order").agg(F.count("*").alias("n"))


@query
def fn15_16_nulls(v):
    t2 = F.col("time_2")
    return v.habit_peaks().select(
        "customer_key", sem.fill_null(t2, 0).alias("time_2"), t2.isNull().alias("is_missing")
    )


@query
def fn18_20_numbers(v):
    ms = F.col("milliseconds_spent")
    return v.read_duration_fact().groupBy("product_key").agg(
        clock.minutes(F.sum(ms)).alias("minutes"),
        text.log_intensity(F.count("*")).alias("log_n"),
        F.rint(F.avg(ms / 1000)).alias("mean_secs"),
        F.abs(F.min(ms) - F.max(ms)).alias("span"),
    )


@query
def fn21_24_text(v):
    key = F.col("thema_category_key")
    return v.theme_category().select(
        key,
        text.remove_first(F.col("level1_danish"), r"Bøger\|").alias("short_name"),
        text.joined_label(F.col("category_group"), F.col("category"), key).alias("label"),
        text.peak_label(key * 600).alias("peak_label"),
        F.substring("category", 2, 3).try_cast("int").alias("category_number"),
        F.col("level1_english").try_cast("int").alias("not_a_number"),
    )


@query
def fn25_interval_bins(v):
    return scaling.interval_bin(customer_events(v).select("customer_key", "secs"), "secs", 24)


@query
def fn26_27_look_back_limits(v):
    as_of = cal.date_of_key(F.col("date_key"))
    days = v.reader_fact().select("date_key").distinct()
    return days.select(
        "date_key",
        *[cal.key_days_before(as_of, d).alias(f"key_{d}") for d in (7, 45, 60)],
        cal.days_before(as_of, 3).alias("settled"),
    )


@query
def fn28_stamps(v):
    ts = F.col("event_timestamp")
    stamp = F.date_format(ts, "yyyy/MM/dd HH:mm")
    return v.game_events().select(
        clock.format_clock(ts).alias("clock"),
        clock.parse_minute_stamp(stamp).alias("minute"),
        clock.parse_minute_stamp(F.col("user_country")).alias("no_stamp"),
    )


# ---- clustering operators ------------------------------------------------------------------


@query
def ml1_scaled_band_shares(v):
    columns = clock.BAND_NAMES
    return scaling.standardise(bands(v), columns).select("customer_key", *[f"{c}_scaled" for c in columns])


@query
def ml1_scaled_with_nulls(v):
    return scaling.standardise(v.habit_peaks().select("customer_key", "time_1", "time_2"), ["time_1", "time_2"])


def _given_clusters(v):
    centres = kmeans.read_centers(given_centroids(v), clock.BAND_NAMES)
    return kmeans.nearest(bands(v), clock.BAND_NAMES, centres)


@query
def ml3_nearest_given_centroid(v):
    return _given_clusters(v).select("customer_key", "cluster")


@query
def ml4_given_centroids(v):
    return given_centroids(v)


def _scaled_bands(v):
    scaled = scaling.standardise(bands(v), clock.BAND_NAMES)
    return scaled, [f"{c}_scaled" for c in clock.BAND_NAMES]


@query
def ml2_ml4_fitted_centroids(v):
    scaled, columns = _scaled_bands(v)
    return kmeans.fit(scaled, columns, 3).table(v.spark)


@query
def ml5_total_spread(v):
    scaled, columns = _scaled_bands(v)
    return kmeans.elbow(scaled, columns, [1])


@query
def ml6_estimated_centroids(v):
    scaled, columns = _scaled_bands(v)
    return kmeans.estimate_k(scaled, columns, 10).table(v.spark)


@query
def ml7_spread_per_cluster(v):
    return kmeans.cluster_spread(_given_clusters(v), clock.BAND_NAMES)


@query
def ml9_modes_elbow(v):
    return segments.profile_elbow(profiles(v))


@query
def udf1_customer_centers(v):
    return peaks.customer_centers(customer_events(v), ["customer_key"])


@query
def udf1_customer_centers_fine(v):
    found = peaks.customer_centers(customer_events(v), ["customer_key"], cutoff=0.55, standardise=False)
    return found.withColumn("wss", F.round("wss"))


# ---- analyses ------------------------------------------------------------------------------


@query
def weekday_hour_share(v):
    return activity.weekday_hour_share(v.reader_fact(), v.time_of_day(), AS_OF)


@query
def weekday_hour_heatmap(v):
    return activity.weekday_hour_heatmap(v.reader_fact(), v.time_of_day(), AS_OF)


@query
def customer_weekday_hour_heatmap(v):
    return activity.customer_weekday_hour_heatmap(v.reader_fact(), v.time_of_day(), CUSTOMERS, AS_OF)


@query
def customer_hour_heatmap(v):
    return activity.customer_hour_heatmap(v.reader_fact(), v.time_of_day(), None, AS_OF)


@query
def category_weekday_hour_heatmap(v):
    return activity.category_weekday_hour_heatmap(themed_week(v))


@query
def fiction_heatmap(v):
    return activity.single_category_heatmap(themed_week(v), "Skønlitteratur")


@query
def nonfiction_heatmap(v):
    return activity.single_category_heatmap(themed_week(v), "Faglitteratur")


@query
def theme_events(v):
    return themed(v)


@query
def category_frequencies(v):
    return activity.all_category_frequencies(themed_week(v))


@query
def level1_frequencies(v):
    return activity.category_frequencies(themed_week(v), "level1_danish")


@query
def product_time_profile(v):
    return activity.product_time_profile(themed(v), 68)


@query
def column_cardinalities(v):
    return activity.column_cardinalities(v.theme_category().where(F.col("thema_category_key") > 0))


@query
def sample_events(v):
    return ev.sample_events(v.reader_fact(), v.time_of_day(), AS_OF)


@query
def customer_modal_weekday(v):
    return habits.modal_weekday(habits.week_counts(customer_events(v)))


@query
def customer_modal_hour(v):
    return habits.modal_hour(habits.week_counts(customer_events(v)))


@query
def customer_modal_slot(v):
    return habits.modal_slot(habits.week_counts(customer_events(v)))


@query
def customer_weekend_ratio(v):
    return habits.weekend_ratio(habits.week_counts(customer_events(v)))


@query
def customer_median_time(v):
    return habits.median_time(customer_events(v))


@query
def customer_median_time_strict(v):
    return habits.median_time(customer_events(v), unknown="propagate")


@query
def customer_habit_profile(v):
    return habits.habit_profile(customer_events(v))


@query
def typical_slot(v):
    return habits.typical_slot(customer_events(v))


@query
def weekday_start_time(v):
    return habits.weekday_start_time(customer_events(v))


@query
def daily_consumption(v):
    return usage.daily_consumption(clean(v))


@query
def daily_customer_minutes(v):
    return usage.daily_customer_minutes(clean(v))


@query
def daily_titles_per_customer(v):
    return usage.daily_titles_per_customer(clean(v))


@query
def daily_distinct_titles_per_customer(v):
    return usage.daily_titles_per_customer(clean(v), distinct_titles=True)


@query
def average_daily_minutes(v):
    return usage.average_daily_minutes(clean(v))


@query
def member_usage(v):
    return usage.member_usage(v.member(), v.reader_fact(), v.read_duration_fact(), SINCE_START)


@query
def member_usage_recent(v):
    return usage.member_usage(v.member(), v.reader_fact(), v.read_duration_fact(), SINCE_RECENT)


@query
def top_members(v):
    return usage.top_members(v.member(), v.reader_fact(), v.read_duration_fact(), SINCE_RECENT, SINCE_START, n=40)


@query
def bucket_matrix(v):
    return _numbered(completion.bucket_matrix(bucket_reads(v), BUCKETS))


@query
def bucket_gaps(v):
    return _numbered(completion.bucket_gaps(bucket_reads(v), BUCKETS))


def _numbered(wide: DataFrame) -> DataFrame:
    return wide.withColumnsRenamed({str(b): f"b{b}" for b in BUCKETS})


@query
def start_time_density(v):
    return per_day(densities.start_time_density(starts(v)))


@query
def start_time_peak(v):
    return densities.start_time_peak(starts(v))


@query
def country_time_density(v):
    return per_day(densities.country_time_density(v.countries(), starts(v)))


@query
def country_time_density_without_one(v):
    return per_day(densities.country_time_density(v.countries(), starts(v), exclude=["N0"]))


@query
def category_time_density(v):
    return per_day(densities.category_time_density(themed(v)))


@query
def customer_time_density(v):
    return per_day(densities.customer_time_density(customer_events(v)))


@query
def den3_density_per_weekday(v):
    return per_day(density.density(customer_events(v), "secs", ["weekday"]))


@query
def customer_peaks(v):
    e = customer_events(v).select("customer_key", "secs", cal.weekday_label(F.col("weekday")).alias("week_day"))
    return segments.customer_peaks(e)


@query
def customer_peaks_fine(v):
    e = customer_events(v).select("customer_key", "secs", cal.weekday_label(F.col("weekday")).alias("week_day"))
    return segments.customer_peaks(e, cutoff=0.55)


@query
def hour_share_features(v):
    return hours(v)


@query
def band_share_features(v):
    return bands(v)


@query
def regularity_features(v):
    return segments.regularity_features(customer_events(v))


# ---- the same from stored daily counts ------------------------------------------------------


def stored_counts(v: Views) -> DataFrame:
    """All days before the recent ones stored at once, then the recent ones added, of which the first comes twice."""
    fact, clock_rows = v.reader_fact(), v.time_of_day()
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    where = rhythm.layout(scratch_path(v.spark, "daily-counts"), buckets)
    table = rhythm.store(v.spark, fact.where(F.col("date_key") < SINCE_RECENT), clock_rows, where)
    rhythm.store(v.spark, fact, clock_rows, where, table, [SINCE_RECENT])
    rhythm.store(v.spark, fact.where(F.col("date_key") >= SINCE_RECENT), clock_rows, where, table)
    return rhythm.window(v.spark, table, AS_OF)


@query
def stored_counts_habit_profile(v):
    return habits.habit_profile(stored_counts(v), counted="n")


@query
def stored_counts_typical_slot(v):
    return habits.typical_slot(stored_counts(v), counted="n")


@query
def stored_counts_regularity_features(v):
    return segments.regularity_features(stored_counts(v), counted="n")


@query
def stored_counts_band_shares(v):
    return segments.band_share_features(stored_counts(v), counted="n")


@query
def stored_counts_customer_peaks(v):
    return segments.customer_peaks(stored_counts(v), counted="n")


@query
def regularity_segments(v):
    return segments.regularity_segments(segments.regularity_features(customer_events(v)))


@query
def hour_segments(v):
    return segments.hour_segments(hours(v))


@query
def band_segments(v):
    return segments.band_segments(bands(v))


@query
def elbow_curve(v):
    return segments.elbow_curve(bands(v), clock.BAND_NAMES)


@query
def elbow_curve_hours(v):
    return segments.elbow_curve(hours(v), segments.HOUR_COLUMNS)


@query
def elbow_curve_regularity(v):
    return segments.elbow_curve(segments.regularity_features(customer_events(v)), ["median_scaled", "sd_scaled"])


@query
def centroid_profile(v):
    return segments.centroid_profile(given_centroids(v))


@query
def hour_centroid_profile(v):
    group = (F.col("customer_key") % 3 + 1).cast("int").alias("centroid")
    centres = hours(v).groupBy(group).agg(*[F.avg(h).alias(h) for h in segments.HOUR_COLUMNS])
    return segments.hour_centroid_profile(centres)


@query
def habit_type(v):
    return segments.habit_type(v.habit_peaks())


@query
def habit_type_of_events(v):
    e = customer_events(v).select("customer_key", "secs", cal.weekday_label(F.col("weekday")).alias("week_day"))
    return segments.habit_type(segments.customer_peaks(e, cutoff=0.55)).select("customer_key", "weekday", "time_type")


@query
def content_counts(v):
    return content(v)


@query
def format_preference(v):
    return segments.format_preference(content(v))


@query
def genre_preference(v):
    return segments.genre_preference(content(v))


@query
def customer_profiles(v):
    return profiles(v)


@query
def profile_segments(v):
    return segments.profile_segments(profiles(v))


@query
def profile_counts(v):
    return segments.profile_counts(profiles(v))


@query
def cluster_stability(v):
    return segments.cluster_stability(bands(v), clock.BAND_NAMES, replicates=10)


def _given_segments(v):
    key = F.col("customer_key")
    return bands(v).withColumns({"segment1": (key % 3 + 1).cast("int"), "segment2": (key % 6 + 1).cast("int")})


@query
def segment_feature_table(v):
    return segments.segment_feature_table(segments.habit_type(v.habit_peaks()), _given_segments(v))


@query
def segment_feature_table_fitted(v):
    return segments.segment_feature_table(segments.habit_type(v.habit_peaks()), segments.band_segments(bands(v)))


@query
def peak_points_long(v):
    return segments.peak_points(segments.habit_type(v.habit_peaks()))
