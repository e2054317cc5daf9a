"""Which kinds of customers are there? Features, clusters, rules and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import WEEKDAY_LABELS, day_class, weekday_label
from ..functions.clock import BAND_NAMES, at, band_ordinal, clock_text, hour_of, round_to_step, time_band
from ..functions.semantics import fill_null, if_else, not_in
from ..functions.text import joined_label
from ..operators import kmeans, kmodes
from ..operators.grid import columns_starting, pivot_many, pivot_values, to_long
from ..operators.joins import null_safe_join, semi_on_keys
from ..operators.peaks import customer_centers
from ..operators.ranking import number_within, quantile_bucket, sorted_rows
from ..operators.sampling import sample_keys
from ..operators.scaling import standardise
from ..operators.stats import histogram, median_and_sd, modal, rows_of
from ..session import cut_lineage

KEY = "customer_key"
HOUR_COLUMNS = [f"h{h}" for h in range(24)]
WEEKEND = WEEKDAY_LABELS["english"][5:]
PROFILE = ["time_type", "weekday", "format", "litt_pref"]

# ---- shares of hours and bands -------------------------------------------------------------


def active_customers(events: DataFrame, min_events: int = 20) -> DataFrame:
    """Customers with enough events."""
    return events.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_events).select(KEY)


def workday_shares(
    events: DataFrame, part: Column, name: str, min_events: int = 20, counted: str | None = None
) -> DataFrame:
    """Share of a customer's workday events per part of the day.

    The activity gate counts all events, the shares only those not on a weekend (an unknown
    weekday is not a weekend). Both totals come from one count per customer, part and kind of day.
    """
    workday = not_in(F.col("week_day"), WEEKEND).alias("workday")
    counts = events.groupBy(KEY, part.alias(name), workday).agg(rows_of(counted).alias("n"))
    own = Window.partitionBy(KEY)
    totals = counts.withColumns({
        "_all": F.sum("n").over(own),
        "sum_n": F.sum(F.when(F.col("workday"), F.col("n"))).over(own),
    })
    gated = totals.where(F.col("workday") & (F.col("_all") >= min_events))
    return gated.select(KEY, name, "n", "sum_n", (F.col("n") / F.col("sum_n")).alias("prop_n"))


def hour_share_features(events: DataFrame, min_events: int = 20, counted: str | None = None) -> DataFrame:
    """24 workday hour shares per customer; an hour without events is 0."""
    shares = workday_shares(events, hour_of(F.col("secs")), "hour", min_events, counted)
    wide = pivot_values(shares, [KEY], "hour", list(range(24)), "prop_n", fill=0.0)
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in range(24)})


def band_share_features(events: DataFrame, min_events: int = 20, counted: str | None = None) -> DataFrame:
    """Six workday shares per customer, one per part of the day."""
    shares = workday_shares(events, time_band(hour_of(F.col("secs"))), "time_band", min_events, counted)
    return pivot_values(shares, [KEY], "time_band", BAND_NAMES, "prop_n", fill=0.0)


def _scaled(features: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return standardise(features, columns), [f"{c}_scaled" for c in columns]


def hour_segments(features: DataFrame, k_max: int = 10, seed: int = 62) -> DataFrame:
    """Customers with an hour segment; the number of segments is estimated."""
    scaled, columns = _scaled(features, HOUR_COLUMNS)
    found = kmeans.estimate_k(scaled, columns, k_max, seed)
    return found.assign(scaled, "segment").select(*features.columns, "segment")


def band_segments(features: DataFrame, small: int = 3, large: int = 6, seed: int = 62) -> DataFrame:
    """Customers with a coarse and a fine band segment."""
    scaled, columns = _scaled(features, BAND_NAMES)
    coarse, fine = kmeans.fit_each(scaled, columns, [small, large], seed)
    out = fine.assign(coarse.assign(scaled, "segment1"), "segment2")
    return out.select(*features.columns, "segment1", "segment2")


def elbow_curve(features: DataFrame, columns: Sequence[str], k_max: int = 25, seed: int = 62) -> DataFrame:
    """Total within-cluster sum of squares for 1 to k_max clusters of the scaled features."""
    scaled, names = _scaled(features, columns)
    return kmeans.elbow(scaled.select(*names), names, range(1, k_max + 1), seed)


def centroid_profile(centroids: DataFrame, bands: Sequence[str] = BAND_NAMES) -> DataFrame:
    """Centre values in long form, bands in the order of the day."""
    long = to_long(centroids, ["centroid"], bands).withColumn("band_order", band_ordinal(F.col("name")))
    return number_within(long, ["centroid"], ["band_order"]).drop("band_order")


def hour_centroid_profile(centroids: DataFrame, columns: Sequence[str] = HOUR_COLUMNS) -> DataFrame:
    """Centre values in long form, the hour as a number."""
    long = to_long(centroids, ["centroid"], columns)
    hour = F.regexp_replace("name", "[^0-9]", "").cast("int")
    return long.select("centroid", hour.alias("name"), "value")


def cluster_stability(features: DataFrame, columns: Sequence[str], replicates: int = 10, seed: int = 62) -> DataFrame:
    """Centres of the scaled features on repeated random parts of the customers."""
    scaled, names = _scaled(features, columns)
    return kmeans.stability(scaled, [KEY], names, replicates, seed=seed)


# ---- regularity ----------------------------------------------------------------------------


def regularity_features(events: DataFrame, unknown: str = "skip", counted: str | None = None) -> DataFrame:
    """Median and spread of the time of day, scaled over customers.

    Scaling uses every known value; customers without a spread are dropped after it.
    """
    stats = median_and_sd(histogram(events, [KEY], "secs", counted=counted), [KEY], "secs", unknown=unknown)
    named = stats.select(KEY, F.col("median").alias("median_time"), F.col("sd").alias("sd_time"))
    scaled = standardise(named, ["median_time", "sd_time"])
    return scaled.withColumnsRenamed({"median_time_scaled": "median_scaled", "sd_time_scaled": "sd_scaled"}).dropna("any")


def regularity_segments(features: DataFrame, k: int = 4, seed: int = 62) -> DataFrame:
    """Regularity features with their cluster."""
    return kmeans.fit(features, ["median_scaled", "sd_scaled"], k, seed).assign(features)


# ---- daily peaks ---------------------------------------------------------------------------


def modal_weekdays(events: DataFrame, counted: str | None = None) -> DataFrame:
    """Most frequent weekday name per customer, alphabetical on a tie."""
    return modal(events, [KEY], "week_day", "day_mode", counted)


def peak_table(centers: DataFrame, events: DataFrame, k: int = 3, counted: str | None = None) -> DataFrame:
    """One row per customer: modal weekday, peak times and how spread they are (1 to 5).

    Every customer of the events is listed, also without peaks.
    """
    # Ranked to six places: equal spreads that differ in the last bit are ties, settled by key.
    ranked = centers.withColumn("wss", F.round("wss", 6))
    graded = quantile_bucket(ranked, "wss", 5, [KEY, "centroid"], "wss_bucket")
    cells = graded.select(
        KEY, "centroid", round_to_step(F.col("secs"), 2).alias("time"), F.col("wss_bucket").alias("wss")
    )
    wide = pivot_many(cells, [KEY], "centroid", range(1, k + 1), ["time", "wss"])
    # The weekdays list everyone; the weekday itself is shown for customers with peaks only.
    listed = null_safe_join(wide.withColumn("_peaks", F.lit(True)), modal_weekdays(events, counted), [KEY], "full")
    columns = [f"{v}_{i}" for i in range(1, k + 1) for v in ("time", "wss")]
    return listed.select(KEY, F.when(F.col("_peaks"), F.col("day_mode")).alias("day_mode"), *columns)


def customer_peaks(
    events: DataFrame,
    k: int = 3,
    min_distinct: int = 20,
    cutoff: float | None = None,
    standardise_wss: bool = True,
    counted: str | None = None,
) -> DataFrame:
    """Up to three daily reading times per customer."""
    centers = customer_centers(events, [KEY], "secs", k, min_distinct, cutoff, standardise_wss, counted)
    # Ranking reads the centres several times; they are fitted once.
    return peak_table(cut_lineage(centers), events, k, counted)


def habit_type(peaks: DataFrame) -> DataFrame:
    """Label the daily habit from peaks and modal weekday; the first rule that holds wins."""
    time = {i: F.col(f"time_{i}") for i in (1, 2, 3)}
    between = lambda c, low, high: (c > at(low)) & (c < at(high))
    weekday = day_class(F.col("day_mode"))
    label = (
        F.when(F.col("wss_2").isNull() & (F.col("wss_1") >= 4), "Allday")
        .when(
            between(time[1], "05:30:00", "10:00:00")
            & between(time[2], "14:00:00", "18:30:00")
            & (weekday == "Workday"),
            "Commuter",
        )
        .when((time[1] < at("04:00:00")) & ((time[2] > at("21:00:00")) | (time[3] > at("21:00:00"))), "Nighttime")
        .when(time[3].isNotNull(), "multiple")
        .when(time[1].isNull(), "None")
        .otherwise("Other")
    )
    return peaks.withColumns({"weekday": weekday, "time_type": label})


def segment_feature_table(habits: DataFrame, bands: DataFrame) -> DataFrame:
    """Peak times next to band shares and band segments."""
    joined = null_safe_join(habits, bands, [KEY])
    return joined.select("time_1", "time_2", *BAND_NAMES, "segment1", "segment2")


def peak_points(habits: DataFrame, n: int = 30, seed: int = 62) -> DataFrame:
    """Peak times of n sampled customers, one row per peak column."""
    chosen = semi_on_keys(habits, sample_keys(habits, [KEY], n, seed), [KEY])
    times = [c for c in columns_starting(habits, "time") if c != "time_type"]
    return to_long(chosen, [KEY], times)


# ---- preferences and profiles --------------------------------------------------------------


def content_counts(fact: DataFrame, products: DataFrame, genres: DataFrame) -> DataFrame:
    """Events per customer, product type and genre, digital products of known customers only.

    Events are counted per customer and product before the dimensions join, so a bestseller is
    one row per reader there. An event counts once per genre of its product.
    """
    digital = products.where(F.col("type_group") == "Dig").select("product_key", "type")
    counted = (
        fact.where(F.col("customer_key") != -1).groupBy(KEY, "product_key").agg(F.count("*").alias("n"))
    )
    joined = counted.join(digital, "product_key").join(genres, "product_key", "left")
    return joined.groupBy(KEY, "type", "genre_level1").agg(F.sum("n").alias("n"))


def _lean(by: str, category: str) -> Column:
    """Events of one category; a category without any counts 0.1."""
    return fill_null(F.sum(F.when(F.col(by) == category, F.col("n"))).cast("double"), 0.1)


def preferences(counts: DataFrame) -> DataFrame:
    """Audiobooks against e-books and fiction against non-fiction, in one pass per customer."""
    sums = counts.groupBy(KEY).agg(
        _lean("type", "Lydbøger").alias("audio"),
        _lean("type", "E-bøger").alias("ebook"),
        _lean("genre_level1", "Skønlitteratur").alias("fiction"),
        _lean("genre_level1", "Fagbøger").alias("fact"),
    )
    audio, ebook, fiction, fact = (F.col(c) for c in ("audio", "ebook", "fiction", "fact"))
    return sums.select(
        KEY,
        (audio / ebook).alias("lyd_ratio"),
        if_else(audio >= ebook, F.lit("Lyd"), F.lit("E-bog")).alias("format"),
        (fiction / fact).alias("fiction_ratio"),
        if_else(fiction >= fact, F.lit("Skøn"), F.lit("Fag")).alias("litt_pref"),
    )


def format_preference(counts: DataFrame) -> DataFrame:
    """Audiobooks against e-books."""
    return preferences(counts).select(KEY, "lyd_ratio", "format")


def genre_preference(counts: DataFrame) -> DataFrame:
    """Fiction against non-fiction."""
    return preferences(counts).select(KEY, "fiction_ratio", "litt_pref")


def customer_profiles(habits: DataFrame, preferred: DataFrame) -> DataFrame:
    """Habit, format and genre of customers that have all three and a known habit."""
    known = habits.where(F.col("time_type") != "None")
    return null_safe_join(known, preferred, [KEY]).select(KEY, *PROFILE)


def profile_segments(profiles: DataFrame, k: int = 3) -> DataFrame:
    """Customers with a k-modes cluster, named by the cluster's most typical values."""
    found = kmodes.fit(profiles, PROFILE, k)
    return found.named(found.assign(profiles))


def profile_elbow(profiles: DataFrame, k_max: int = 15) -> DataFrame:
    """Mean within-cluster difference for 1 to k_max modes."""
    return kmodes.elbow(profiles, PROFILE, range(1, k_max + 1))


def profile_counts(profiles: DataFrame) -> DataFrame:
    """How many customers share each profile, rarest first."""
    counts = profiles.groupBy(*PROFILE).agg(F.count("*").alias("n"))
    return sorted_rows(counts.withColumn("segment", joined_label(*[F.col(c) for c in PROFILE])), "n", "segment")
