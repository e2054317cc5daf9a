"""URL lists over time: which entries were active when a page was fetched.

Dated entries (add or remove a pattern) become validity intervals, and every capture meets, as of its
day, the intervals of the patterns that cover its URL. A pattern is a host (``b.example.com`` covers
itself and the hosts below it) or a host with a path (``example.com/ads`` covers that path and what
lies below it). The most specific active entry decides, an allowing one before a blocking one.

Only DataFrame operations. What is asked is first collapsed to distinct patterns and days, so a hot host is as many
rows as it has days. Each is then merged, as of its day, with the changes of every list that knows the pattern: one window
per list and pattern in the order of days takes, of the intervals that have begun, the one that ends last, however long
an interval is or how far away a day. The captures meet what was decided for their pattern and day in an equal join that Spark can split.

Defined results: a null or unparsable URL or a null day matches nothing and has a null verdict; any day of the calendar
may be asked for; intervals of one entry may overlap (``since`` is then that of the one that ends last); entries
with a null pattern, day, list or action are left out; a pattern added and removed on one day is removed
on that day; repeated captures are returned as often as they occur; empty tables give empty results or
null verdicts. Hosts compare in lower case without port, user and final dot, paths as they are
without final slashes. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import picked

def host(url: Column) -> Column:
    """Host of an absolute URL in lower case; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(F.lower(bare), r"\.$", ""), F.lit(""))


def place(url: Column) -> Column:
    """Host and path without query, fragment and final slashes."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, r"/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, allows, pattern, since, until) from dated entries (list, allows, pattern, day, action).

    ``until`` is the day of removal and no longer covered; null while the entry stands.
    An entry's days are collapsed first, so the window holds at most one row a day.
    """
    known = entries.where("pattern is not null and day is not null and list is not null and action in ('add', 'remove')")
    daily = known.groupBy("list", "allows", "pattern", "day").agg(
        F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("_off")
    )
    history = Window.partitionBy("list", "allows", "pattern").orderBy("day")
    changed = daily.withColumn("_was", F.lag("_off", 1, 1).over(history)).where("_off <> _was")
    spans = changed.withColumn("until", F.lead("day").over(history)).where("_off = 0")
    return spans.select("list", "allows", "pattern", F.col("day").alias("since"), "until")


def covering(url: Column, deepest: Column) -> Column:
    """The patterns that cover a URL: its host, the hosts above, and its paths down to ``deepest`` levels."""
    name = host(url)
    labels = F.split(name, r"\.")
    top = F.when(name.rlike(r"^[0-9.]+$|^\[") | (F.size(labels) < 2), F.lit(1)).otherwise(F.size(labels) - 1)
    above = F.transform(F.sequence(F.lit(1), top), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    levels = F.split(place(url), "/")
    depth = F.least(F.size(levels), deepest)
    paths = F.transform(
        F.when(depth >= 2, F.sequence(F.lit(2), depth)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(levels, 1, i), "/"),
    )
    return F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(above, paths)))


def _decided(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """pattern, _day and _entry: the entry that counts for each asked pattern and day, where one is active."""
    entry = ["list", "allows", "pattern"]
    # compared by its end, one that stands after all that end
    span = F.struct(F.col("until").isNull().alias("stands"), "until", "since")
    changes = spans.select(*entry, F.col("since").alias("day"), F.lit(0).alias("_asked"), span.alias("_span"))
    questions = asked.join(spans.select(*entry).distinct(), "pattern").select(*entry, "day", F.lit(1).alias("_asked"))
    # a change counts from its own day on
    upto = Window.partitionBy(*entry).orderBy("day", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = changes.unionByName(questions, allowMissingColumns=True).withColumn("_span", F.max("_span").over(upto)).where("_asked = 1")
    active = merged.where("_span.stands or day < _span.until")
    best = F.struct(F.length("pattern").alias("specific"), "allows", "list", "pattern", F.col("_span.since").alias("since"))
    return active.groupBy("pattern", F.col("day").alias("_day")).agg(F.max(best).alias("_entry"))


def as_of(captures: DataFrame, spans: DataFrame, key: str = "page_id", url: str = "url", day: str = "day") -> DataFrame:
    """key, url, day, verdict ('allow', 'block' or null), list, pattern and since of the deciding entry."""
    rows = picked(captures, key=key, url=url, day=day).groupBy("key", "url", "day").agg(F.count("*").alias("_times"))
    known = spans.select("list", F.coalesce("allows", F.lit(False)).alias("allows"), "pattern", "since", "until")
    deepest = known.agg(F.coalesce(F.max(F.size(F.split("pattern", "/"))), F.lit(1))).scalar()
    open_ = rows.withColumn("_deepest", deepest)
    open_ = open_.withColumn("_pattern", F.explode_outer(covering(F.col("url"), F.col("_deepest")))).drop("_deepest")
    asked = open_.where("_pattern is not null and day is not null").select(F.col("_pattern").alias("pattern"), "day").distinct()
    met = open_.join(_decided(asked, known), (F.col("_pattern") == F.col("pattern")) & (F.col("day") == F.col("_day")), "left")
    decided = met.groupBy("key", "url", "day", "_times").agg(F.max("_entry").alias("_entry"))
    verdict = F.when(F.col("_entry").isNotNull(), F.when(F.col("_entry.allows"), "allow").otherwise("block"))
    every = decided.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return every.select(
        F.col("key").alias(key),
        F.col("url").alias(url),
        F.col("day").alias(day),
        verdict.alias("verdict"),
        F.col("_entry.list").alias("list"),
        F.col("_entry.pattern").alias("pattern"),
        F.col("_entry.since").alias("since"),
    )
